import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankframe.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def plain_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain_dedup(rows, min_chars=40, min_docs=5):
    """(n_lines, n_dropped, text) of each (id, text), step by step."""
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[plain_key(line)].add(doc)
    rank = lambda d: (d is not None, d if d is not None else 0)
    top = {k: max(d, key=rank) for k, d in held.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if plain_key(x) not in top or top[plain_key(x)] == doc]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def made_rows(seed, n=240):
    r = random.Random(seed)
    common = [f"  Line {i} that MANY documents share ÄÖİ {'x' * r.randint(10, 30)}\t" for i in range(12)]
    short = ["short line", "x" * 39, " " * 60, "é" * 39]
    rows = []
    for i in range(n):
        lines = [r.choice([r.choice(common), r.choice(common).upper().strip(), r.choice(short), f"own line {i} {r.random()} padding padding", ""]) for _ in range(r.randint(0, 200 if i % 40 == 0 else 8))]
        if i % 3 == 0:
            lines.insert(0, "the line of a third of all documents, over and over")
        rows.append((r.choice([i, i, i, None if i % 50 == 0 else i]), "\n".join(lines)))
    rows += rows[:7] + [(3, "the line of a third of all documents, over and over"), (None, None), (5, None), (6, "")]
    return rows


def same(got, rows, **params):
    want = plain_dedup(rows, **params)
    key = lambda x: tuple((v is None, str(v)) for v in x)
    return sorted(((r[0], r[1], *r[2]) for r in got), key=key) == sorted(((d, t, *w) for (d, t), w in zip(rows, want)), key=key)


@pytest.mark.parametrize("seed,sample,broadcast", [(1, 20_000, 32 << 20), (2, 1, 0), (3, 60, 0)])
def test_equals_a_plain_pass(spark, seed, sample, broadcast):
    rows = made_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = L.dedup_lines(df, sample_docs=sample, broadcast_bytes=broadcast)
    assert same(got.select("doc_id", "text", "lines").collect(), rows)
    low = L.dedup_lines(df, sample_docs=sample, min_chars=10, min_docs=2).select("doc_id", "text", "lines").collect()
    assert same(low, rows, min_chars=10, min_docs=2)


def test_hot_keys_are_dealt_out(spark):
    rows = [(i, "a very common line that opens each document\nown line of this document number %d padded" % i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = L._hot_keys(df, "doc_id", "text", 40, 8, 20_000).collect()
    assert len(hot) == 1
    assert same(L.dedup_lines(df).select("doc_id", "text", "lines").collect(), rows)
    gone = L.lines_to_drop(df)
    assert gone.count() == 399 and gone.filter("doc = 399").count() == 0


def test_bitmaps_are_compressed(spark):
    twin = "this line is in six documents and so it will be dropped"
    long = "\n".join(["s"] * 1000 + [twin] + ["s"] * 5000 + [twin] * 3 + ["s"] * 400)
    rows = [(i, long if i == 0 else twin) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = L.keep_bitmaps(df).filter("doc = 0").first()
    assert r.n_dropped == 4
    words = []
    for full, bits in r.keep:
        words += [-1] * full + [bits]
    zeros = [64 * w + i for w, bits in enumerate(words) for i in range(64) if not (bits >> i) & 1]
    assert zeros == [1000, 6001, 6002, 6003] and len(r.keep) == 2
    assert same(L.dedup_lines(df).select("doc_id", "text", "lines").collect(), rows)


def test_edges(spark, edge_docs, no_docs):
    names = ("doc", "text_hash", "pos", "h1", "h2", "hot", "part", "keep", "n_dropped", "line", "fresh", "top", "lines")
    clash = edge_docs.withColumns({c: F.lit("user") for c in names})
    got = L.dedup_lines(clash)
    assert got.columns == [c for c in clash.columns if c != "lines"] + ["lines"]
    rows = got.collect()
    assert all(r[c] == "user" for r in rows for c in names[:-1])
    assert same([(r.doc_id, r.text, r.lines) for r in rows], [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert L.dedup_lines(no_docs).count() == 0


def test_query(spark, sf):
    from rankframe.llm.suite import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_line_dedup"](spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(d, n, k, sha(t)) for (d, _), (n, k, t) in zip(rows, plain_dedup(rows))}
    assert {tuple(r) for r in got.collect()} == want


def test_rows_are_exchanged_once_and_sorted_once(spark):
    df = spark.createDataFrame(made_rows(4), "doc_id long, text string")
    plans = []
    checkpoint = type(df).checkpoint
    try:
        type(df).checkpoint = lambda self, *a, **b: plans.append(self._jdf.queryExecution().executedPlan().toString()) or checkpoint(self, *a, **b)
        L.lines_to_drop(df)
    finally:
        type(df).checkpoint = checkpoint
    assert plans[0].count("Exchange shufflepartitionidpassthrough") == 1
    assert plans[0].count("Exchange hashpartitioning") <= 1  # the sample's counts
    assert plans[0].split("Exchange shufflepartitionidpassthrough")[0].count("Sort [") == 1
