import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.operators import dense as DN
from rankframe.operators import evaluation as EV
from rankframe.operators import stats as ST
from rankframe.plans import keyed_ordinal
from rankframe.plans import permute as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ permutation and Heaps curves
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection_and_equals_plain_python(spark, n):
    got = P.with_permuted(spark.range(n), "id", n, 42, "to").collect()
    assert sorted(r.to for r in got) == list(range(n))
    assert all(r.to == P.permuted_int(r.id, n, 42) for r in got)


def test_permutation_in_duckdb_and_at_large_sizes(spark):
    import duckdb

    for n in (10, 999, 10**6 + 3, 10**12 + 39):
        a, b = P.halves(n)
        assert n <= a * b < n + a
        at = sorted({0, n - 1, *(random.Random(n).randrange(n) for _ in range(200))})
        sql = P.permuted_sql("p", str(n), str(a), str(b), 7)
        found = duckdb.sql(f"SELECT p, {sql} FROM (SELECT unnest({at}::BIGINT[]) AS p)").fetchall()
        want = {p: P.permuted_int(p, n, 7) for p in at}
        assert dict(found) == want
        df = spark.createDataFrame([(p,) for p in at], "p long")
        assert {r.p: r.to for r in P.with_permuted(df, "p", n, 7, "to").collect()} == want


def test_permutation_looks_uniform():
    n = 20_000
    to = np.array([P.permuted_int(p, n, 3) for p in range(n)])
    assert abs(np.corrcoef(to, np.arange(n))[0, 1]) < 0.03 and abs(np.corrcoef(to[1:], to[:-1])[0, 1]) < 0.03
    cells = np.histogram2d(np.arange(n), to, bins=10)[0]
    assert ((cells - n / 100) ** 2 / (n / 100)).sum() < 81 + 5 * math.sqrt(162)


def plain_heaps(docs, seed):
    words = [w for d in docs for w in d.split()]
    dealt = [None] * len(words)
    for p, w in enumerate(words):
        dealt[P.permuted_int(p, len(words), seed)] = w
    out = set()
    for variant, flat in (("original", words), ("shuffled", dealt)):
        seen, at = set(), 0
        for o, d in enumerate(docs, 1):
            n = len(d.split())
            seen |= set(flat[at : at + n])
            at += n
            out.add((variant, o, at, len(seen)))
    return out


@pytest.mark.parametrize("docs", [["a b a", "", "c", "a c d " * 40, "e", "", "b f g h"], ["", ""], ["x"], ["a " * 500] + ["b c"] * 30])
def test_heaps_equals_a_plain_pass(spark, docs):
    df = spark.createDataFrame([(i * 10, t) for i, t in enumerate(docs)], "o long, text string")
    got = {tuple(r) for r in ST.heaps_curve(df, "o", seed=5, bucket_size=3).collect()}
    assert got == plain_heaps(docs, 5)


def test_heaps_moves_no_token_arrays_through_a_range_exchange(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(50)], "o long, text string")
    made, kind = [], type(df)
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: made.append((self.dtypes, plan(self))) or real(self, *a, **k))
    last = ST.heaps_curve(df, "o")
    made.append((last.dtypes, plan(last)))
    ranged = [types for types, p in made if "rangepartitioning" in p]
    assert ranged and not any("array" in t or n == "word" for types in ranged for n, t in types)


# ------------------------------------------------------------------ lists of any length
def test_keyed_ordinal(spark):
    rows = [(k, i) for k in ("a", "b", None) for i in range(50 if k == "a" else 5)]
    df = spark.createDataFrame(rows, "k string, i int")
    got = keyed_ordinal(df, ["k"], [F.col("i").desc()], num_partitions=7).collect()
    size = {"a": 50, "b": 5, None: 5}
    assert len(got) == len(rows) and all(r.ordinal == size[r.k] - r.i for r in got)


def plain_ap(run, grades):
    docs = [d for _, d in sorted(((s, d) for d, s in run.items()), reverse=True)]
    hits = ap = 0
    for i, d in enumerate(docs, 1):
        if grades.get(d, 0) >= 1:
            hits += 1
            ap += hits / i
    n = sum(g >= 1 for g in grades.values())
    dcg = sum(grades.get(d, 0) / math.log2(i + 1) for i, d in enumerate(docs, 1))
    ideal = sum(g / math.log2(i + 1) for i, g in enumerate(sorted(grades.values(), reverse=True), 1))
    p10 = sum(grades.get(d, 0) >= 1 for d in docs[:10]) / 10
    return ap / n if n else 0.0, dcg / ideal if ideal else 0.0, p10


def test_uncut_measures_with_one_long_list(spark, monkeypatch):
    """One query holds most rows, a third of them with one score: same values as a plain pass, and no window over a list."""
    r = random.Random(3)
    run = {"long": {f"d{i}": float(r.choice([0, 0, r.randrange(50)])) for i in range(3000)}, "short": {"d1": 1.0, "d2": 2.0}, "none": {"d5": 1.0}}
    grades = {"long": {f"d{r.randrange(4000)}": r.choice([0, 1, 2]) for _ in range(400)}, "short": {"d2": 1, "d9": 2}, "none": {"d7": 0}, "gone": {"d1": 1}}
    rdf = spark.createDataFrame([(q, d, s) for q, x in run.items() for d, s in x.items()], "query_id string, doc_id string, score double").repartition(6)
    qdf = spark.createDataFrame([(q, d, g) for q, x in grades.items() for d, g in x.items()], "query_id string, doc_id string, relevance int")
    measures = {"MAP": EV.Measure("AP"), "nDCG": EV.Measure("nDCG"), "P@10": EV.Measure("P", 10)}
    plans, real = [], type(rdf).checkpoint
    monkeypatch.setattr(type(rdf), "checkpoint", lambda self, *a, **k: plans.append(plan(self)) or real(self, *a, **k))
    got = EV.per_query_metrics(rdf, qdf, measures)
    plans.append(plan(got))
    rows = {x.query_id: x for x in got.collect()}
    assert set(rows) == set(grades)
    for q in grades:
        want = plain_ap(run.get(q, {}), grades[q])
        assert (rows[q]["MAP"], rows[q]["nDCG"], rows[q]["P@10"]) == pytest.approx(want, abs=1e-9)
    assert not any("windowspecdefinition(query_id" in p for p in plans)


def test_missing_queries_of_a_group_are_filled(spark):
    rdf = spark.createDataFrame([("x", "q1", "d", 1.0), ("y", "q2", "d", 1.0)], "run_name string, query_id string, doc_id string, score double")
    qdf = spark.createDataFrame([("q1", "d", 1), ("q2", "d", 1)], "query_id string, doc_id string, relevance int")
    got = EV.per_query_metrics(rdf, qdf, {"P@1": EV.Measure("P", 1), "MAP": EV.Measure("AP")}, group_cols=["run_name"])
    assert {(r.run_name, r.query_id): (r["P@1"], r["MAP"]) for r in got.collect()} == {("x", "q1"): (1, 1), ("x", "q2"): (0, 0), ("y", "q1"): (0, 0), ("y", "q2"): (1, 1)}


# ------------------------------------------------------------------ dense block product
def test_dense_blocks_equal_all_pairs_and_pass_no_driver(spark, monkeypatch):
    r = np.random.default_rng(2)
    docs, queries = np.round(r.normal(size=(300, 8)), 1), np.round(r.normal(size=(70, 8)), 1)
    docs[100:140] = docs[3]  # ties
    vec = lambda x: [[float(v) for v in row] for row in x]
    d = spark.createDataFrame([(f"d{i}", v) for i, v in enumerate(vec(docs))] + [("null", None)], "doc_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(vec(queries))] + [("null", None)], "query_id string, embedding array<float>")
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toLocalIterator", "count", "first"):
            m.setattr(type(d), name, lambda *a, **k: pytest.fail("rows passed the driver"))
        run = DN.dense_search(d, q, top_k=7, score_digits=6, query_rows=16, doc_rows=32)
    scan = [line for line in plan(run).split("\n") if "MapInArrow" in line]
    assert len(scan) == 3  # documents packed once, queries packed once, one product
    got = {}
    for x in run.collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.doc_id, x.score))
    scores = queries.astype(np.float32).astype(float) @ docs.astype(np.float32).astype(float).T
    assert set(got) == {f"q{i}" for i in range(70)}
    for i in range(70):
        want = sorted(((-round(s, 6), f"d{j}") for j, s in enumerate(scores[i])))[:7]
        assert [(k, doc, -s) for k, (s, doc) in enumerate(want, 1)] == [(k, doc, pytest.approx(s, abs=2e-6)) for k, doc, s in sorted(got[f"q{i}"])]
    empty = d.limit(0)
    assert DN.dense_search(empty, q).count() == 0 and DN.dense_search(d, q.limit(0)).count() == 0


def test_dense_groups_of_different_lengths_stay_apart(spark):
    r = np.random.default_rng(4)
    rows = [(f"d{g}{i}", [float(v) for v in r.normal(size=3 + g)], f"g{g}") for i in range(30) for g in (0, 1)]
    d = spark.createDataFrame(rows, "doc_id string, embedding array<double>, ds string").repartition(3)
    q = d.filter("doc_id like '%1'").withColumnRenamed("doc_id", "query_id")
    got = DN.dense_search(d, q, top_k=4, doc_rows=7, query_rows=2, group_col="ds").collect()
    by_id = {i: (v, g) for i, v, g in rows}
    for qid in {x.query_id for x in got}:
        v, g = by_id[qid]
        want = sorted((-float(np.dot(v, w)), i) for i, (w, h) in by_id.items() if h == g)[:4]
        assert [(x.doc_id, x.ds) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == qid] == [(i, g) for _, i in want]


def test_means_are_over_the_judged_queries_of_a_groups_own_dataset(spark):
    run = spark.createDataFrame([("a", "m", "a:1", "x", 1.0), ("b", "m", "b:1", "x", 1.0)], "dataset string, method string, query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("a", "a:1", "x", 1), ("a", "a:2", "x", 1), ("b", "b:1", "x", 1)], "dataset string, query_id string, doc_id string, relevance int")
    got = EV.mean_metrics(run, qrels, {"P@1": EV.Measure("P", 1)}, group_cols=["dataset", "method"], judged_cols=["dataset"]).collect()
    assert {r.dataset: r["P@1"] for r in got} == {"a": 0.5, "b": 1.0}


def test_a_pool_in_several_rows_counts_on(spark):
    from rankframe.operators import pools as PL

    entry = "array<struct<doc_name:string,doc_chunk:string,support:int>>"
    whole = [("t%d" % i, "chunk %d" % (i % 5), i % 2) for i in range(7)]
    one = spark.createDataFrame([("q", "find chunk 3", "s", 0, 1, whole)], f"query_id string, query string, source string, part int, o int, doc_pool {entry}")
    parts = spark.createDataFrame([("q", "find chunk 3", "s", k, 1, whole[3 * k : 3 * k + 3]) for k in range(3)], one.schema)
    how = {"part_col": "part", "part_rows": 3}
    for a, b in zip(PL.build_collection(one, "o"), PL.build_collection(parts, "o", **how)):
        assert sorted(a.collect()) == sorted(b.collect())
    same = lambda df: sorted((r.doc_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert same(PL.pooled_bm25(one)) == same(PL.pooled_bm25(parts, **how)) and PL.pooled_bm25(parts, **how).count() == 7


# ------------------------------------------------------------------ counts and forms inside a row
def test_term_counts_and_places(spark):
    from collections import Counter

    from rankframe.functions.text import term_counts, term_places, tokenize

    texts = ["a b a c", "", "  ", "x", "x x x", "b a é a\tb", " ".join(f"w{i % 37}" for i in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for r in df.select("text", term_counts(tokenize("text")).alias("c"), term_places(tokenize("text")).alias("p")).collect():
        words = (r.text or "").split()
        assert {x.term: x.tf for x in r.c or []} == Counter(words)
        assert {x.word: x.places for x in r.p or []} == {w: [i for i, v in enumerate(words) if v == w] for w in set(words)}


def test_variants_are_rewritten_in_one_pass(spark):
    from rankframe.operators import normalize as NZ

    docs = spark.createDataFrame([("1", "cats running  cats dog"), ("2", ""), ("3", "cat ponies pony"), ("4", None)], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "cats  pony")], "query_id string, text string")
    dv, qv = NZ.text_variants(docs, queries)
    got = {(r.doc_id, r.variant): r.text for r in dv.collect()}
    assert len(got) == 12 and got["1", "original"] == "cats running  cats dog" and got["4", "original"] is None
    assert got["1", "stemmed"] == "cat run cat dog" and got["1", "lemmatized"] == "cat running cat dog"
    assert got["3", "lemmatized"] == "cat pony pony" and got["2", "stemmed"] == "" == got["4", "stemmed"]
    assert {(r.variant, r.text) for r in qv.collect()} == {("original", "cats  pony"), ("stemmed", "cat poni"), ("lemmatized", "cat pony")}
    words = NZ.vocabulary_words(docs.select("text"))
    one = NZ.apply_mapping(docs, "doc_id", NZ.stem_mapping(words))
    assert {r.doc_id: r.text for r in one.collect()} == {d: t for (d, v), t in got.items() if v == "stemmed"}


def test_tfidf_has_one_exchange_of_documents(spark):
    from rankframe.operators import lexical as LX

    docs = spark.createDataFrame([(str(i), f"a b{i % 3} c{i} a") for i in range(40)], "doc_id string, text string").repartition(4, "doc_id")
    queries = spark.createDataFrame([("1", "a b1"), ("2", "c7 a zz")], "query_id string, text string")
    td = LX.tokenized_docs(docs)
    text = plan(LX.tfidf_scores(docs, queries, tok_docs=td))
    assert not any("hashpartitioning" in line and "term" in line and "doc_id" in line for line in text.split("\n"))
    tree = [line for line in text.split("\n") if "Exchange hashpartitioning(doc_id" in line]
    assert len(tree) == 1  # the collection's own clustering


# ------------------------------------------------------------------ size checks, stopword tables
def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    from rankframe.plans.broadcast import checked_broadcast, table_size

    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 10_000).alias("text"), F.array(F.lit("a"), F.repeat(F.lit("b"), 1000)).alias("terms"),
                                  F.struct(F.lit(1).alias("n"), F.array_repeat(F.lit(1.0), 100).alias("v")).alias("s"), F.lit(None).cast("map<string,int>").alias("m"))
    n, size = table_size(wide)
    assert n == 50 and 50 * 11_800 <= size <= 50 * 12_500
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(checked_broadcast(wide)) and not hint(checked_broadcast(wide, max_bytes=100_000)) and not hint(checked_broadcast(wide, max_rows=49))
    assert table_size(wide.limit(0)) == (0, 0)


def test_stopwords_as_a_table(spark, tmp_path):
    from rankframe.sources.files import read_stopwords, write_json_record

    (tmp_path / "stop.txt").write_text("the\n\n of \nthe\n")
    stop = read_stopwords(spark, str(tmp_path / "stop.txt"))
    docs = spark.createDataFrame([("1", "the cat of the hats"), ("2", "hats of"), ("3", "")], "doc_id string, text string")
    by_list, by_table = (ST.term_frequencies(docs, s, ordered=True).collect() for s in (["the", "of"], stop))
    assert by_list == by_table and [r.word for r in by_table] == ["hats", "of", "the", "cat"]
    assert {r.word for r in ST.without_stopwords(ST.term_frequencies(docs, stop), stop).collect()} == {"cat", "hats"}
    write_json_record(ST.stopword_coverage(docs, stop), str(tmp_path / "record"))
    assert spark.read.json(str(tmp_path / "record")).first().stop_occurrences == 4
