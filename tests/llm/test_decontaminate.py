from pyspark.sql import functions as F
import itertools
import math
import random
import re

from rankframe.llm import decontaminate as D

WORDS = [f"w{i}" for i in range(400)]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(doc, item, masks=D.MASKS, window=D.WINDOW, similarity=D.SIMILARITY, least=D.LEAST):
    """All alignments, all runs: a mask hit inside (or around) a run that agrees enough."""
    d, b = tokens(doc), tokens(item)
    if len(b) < least:
        return bool(b) and any(tokens(line) == b for line in (doc or "").split("\n"))
    masks = list(masks) if len(b) >= max(map(len, masks)) else ["1" * len(b)]
    n = min(window, len(b))
    for shift in range(-len(b) + 1, len(d)):
        same = [0 <= shift + j < len(d) and d[shift + j] == b[j] for j in range(len(b))]
        for m in masks:
            for p in range(len(b) - len(m) + 1):
                if all(same[p + i] for i, x in enumerate(m) if x == "1") and 0 <= shift + p and shift + p + len(m) <= len(d):
                    lo, hi = max(0, min(p, p + len(m) - n)), max(p, p + len(m) - n)
                    if any(sum(same[a : a + n]) >= math.ceil(n * similarity) for a in range(lo, min(hi, len(b) - n) + 1)):
                        return True
    return False


def test_matches_brute_force(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choices(WORDS, k=k)) for k in (40, 25, 13, 12, 9, 5, 3)] + ["", None]
    docs = []
    for item in items[:7] * 6:
        w = tokens(item)
        a = rng.randrange(max(1, len(w) - 14)) if rng.random() < 0.5 else 0
        part = w[a : a + rng.choice([9, 11, 12, 13, 14, 40])]
        part = [x if rng.random() > rng.choice([0, 0.08, 0.25]) else "other" for x in part]
        docs.append(" ".join(rng.choices(WORDS, k=30)) + " " + ", ".join(part).upper() + ". " + " ".join(rng.choices(WORDS, k=rng.choice([0, 20]))))
    docs += ["", None, " ".join(WORDS * 20), docs[0]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {i: [j for j, b in enumerate(items) if brute(d, b)] for i, d in enumerate(docs)}
    assert 10 < sum(map(bool, want.values())) < len(docs) - 5
    for extra in ({}, {"broadcast_words": 0}):
        got = {r.doc_id: r for r in D.flag(df, bench, **extra).collect()}
        assert {i: r.item_ids for i, r in got.items()} == {i: ",".join(map(str, x)) for i, x in want.items()}
    clean = D.drop_contaminated(df, bench, broadcast_rows=0)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, x in want.items() if not x]


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, None)], "item_id long, text string")
    got = D.flag(edge_docs, bench).collect()
    assert len(got) == edge_docs.count()
    assert sorted(r.item_ids for r in got if r.contaminated) == ["1"] * 3
    left = D.drop_contaminated(edge_docs, bench)
    assert left.count() == edge_docs.count() - 3 and left.columns == edge_docs.columns
    empty = bench.limit(0)
    assert D.flag(edge_docs, empty).filter("contaminated").count() == 0
    assert D.drop_contaminated(edge_docs, empty).count() == edge_docs.count()
    assert D.flag(no_docs, bench).count() == 0


def agree(doc, item, window=D.WINDOW, similarity=D.SIMILARITY, least=D.LEAST):
    """No masks: any aligned run of ``window`` item words (all of a shorter item) that agrees enough."""
    d, b = tokens(doc), tokens(item)
    n = min(window, len(b))
    for shift in range(-len(b) + 1, len(d)) if len(b) >= least else ():
        same = [0 <= shift + j < len(d) and d[shift + j] == b[j] for j in range(len(b))]
        if any(sum(same[a : a + n]) >= math.ceil(n * similarity) for a in range(len(b) - n + 1)):
            return True
    return False


def test_masks_miss_no_allowed_change():
    for n in range(D.LEAST, D.WINDOW + 1):
        for masks in (D.MASKS, D.FAMILIES[max(k for k in D.FAMILIES if k <= n)]):
            for wrong in itertools.combinations(range(n), n - math.ceil(n * D.SIMILARITY)):
                hits = (all(p + i not in wrong for i, x in enumerate(m) if x == "1") for m in masks for p in range(n - len(m) + 1))
                assert any(hits), (n, masks, wrong)


def test_every_changed_passage_is_found(spark):
    """All single and double changes of items of 5 to 15 words and of a 13-word passage at a text's edges and inside it."""
    rng = random.Random(7)
    items = [" ".join(rng.sample(WORDS, k)) for k in (5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 30)]
    docs = []
    for item in items:
        w = tokens(item)[8:21] if len(tokens(item)) == 30 else tokens(item)
        for wrong in itertools.chain(itertools.combinations(range(len(w)), 1), itertools.combinations(range(len(w)), 2)):
            part = " ".join("other" if i in wrong else x for i, x in enumerate(w))
            docs.append(rng.choice(["", "so it was "]) + part + rng.choice(["", " and so on"]))
    docs += [" ".join(tokens(items[-1])[:11]), " ".join(tokens(items[-1])[-11:]), " ".join(tokens(items[-1])[-10:])]
    want = {i: ",".join(str(j) for j, b in enumerate(items) if agree(d, b)) for i, d in enumerate(docs)}
    assert 300 < sum(map(bool, want.values())) < len(docs) - 50
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in D.flag(df, bench).collect()} == want


def test_short_items_match_equal_lines_only(spark):
    items = spark.createDataFrame([(1, "What is it?"), (2, "one two three four five six seven"), (3, "-- !"), (4, None)], "item_id long, text string")
    texts = ["x\nWHAT is, it\ny", "so what is it then", "what is it", "", None, "a one two three four five six seven b", "--"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.flag(docs, items).collect()}
    assert got == {0: "1", 1: "", 2: "1", 3: "", 4: "", 5: "2", 6: ""}
    assert {r.doc_id: r.item_ids for r in D.flag(docs, items, broadcast_words=0).collect()} == got
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, items).collect()) == [1, 3, 4, 6]


def test_clashing_names_of_the_user_stay(spark):
    names = ("bad_id", "bad_hash", "_bad_id", "_bad_hash", "doc_pos", "key", "near")
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "clean")], "doc_id long, text string").withColumns({n: F.lit("user") for n in names})
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    left = D.drop_contaminated(docs, items)
    assert left.columns == docs.columns and [(r.doc_id, *[r[n] for n in names]) for r in left.collect()] == [(2, *["user"] * len(names))]


def test_large_benchmark_is_not_broadcast(spark):
    """Beyond the bound only the filter of keys is broadcast, and the documents' windows meet it before any exchange."""
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three other five six seven"), (2, "clean")], "doc_id long, text string")
    found = D.contaminated(docs, items, broadcast_words=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "strategy=merge" in plan and plan.count("strategy=broadcast") == 1
    assert [r.doc_id for r in found.collect()] == [1]
