"""Worked examples (hand-computed) for the operators, plus invariants and edge cases."""
import math

import pytest
from pyspark.sql import functions as F

from rankframe.functions.text import combine_title_and_chunk, pool_doc_id, tokenize
from rankframe.operators import evaluation as EV
from rankframe.operators import features as FE
from rankframe.operators import fusion as FU
from rankframe.operators import lexical as LX
from rankframe.operators import ranking as RK
from rankframe.operators import stats as ST
from rankframe.operators import tuning as TU
from rankframe.sources import letor as LE

A = pytest.approx


def docs3(spark):
    return spark.createDataFrame([("d1", "a b"), ("d2", "b c"), ("d3", "c d e")], "doc_id string, text string")


def scores_of(run):
    return {(r.query_id, r.doc_id): r.score for r in run.collect()}


def test_tokenizer_matches_python_split(spark):
    texts = ["  a\tb  c", "x y\x1cz", "p\u0085q　r ", "", "   ", "zw​sp"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokenize("t").alias("k"))
    assert [r.k for r in df.collect()] == [t.split() for t in texts]


def test_bm25_fixture(spark):
    q = spark.createDataFrame([("qa", "a"), ("qbc", "b c"), ("qbb", "b b")], "query_id string, text string")
    run = LX.bm25_search(docs3(spark), q, top_k=3, fill_zeros=True)
    s = scores_of(run)
    assert s[("qa", "d1")] == A(0.545921, abs=1e-6)
    assert s[("qbc", "d1")] == A(0.027296, abs=1e-6)
    assert s[("qbc", "d2")] == A(0.054592, abs=1e-6)
    assert s[("qbc", "d3")] == A(0.022632, abs=1e-6)
    assert s[("qbb", "d1")] == A(0.054592, abs=1e-6)
    # zero fill: query "a" lists d1 then the two zero-score docs in doc_id order
    qa = [r.doc_id for r in run.filter("query_id = 'qa'").orderBy("rank").collect()]
    assert qa == ["d1", "d2", "d3"]


def test_bm25_negative_idf_pool_fill(spark):
    # pooled collections (per-query key) take the general fill path
    docs = spark.createDataFrame([("q1", "d1", "a b"), ("q1", "d2", "b c"), ("q1", "d3", "c d e")], "query_id string, doc_id string, text string")
    q = spark.createDataFrame([("q1", "a")], "query_id string, text string")
    run = LX.bm25_search(docs, q, top_k=3, collection_cols=["query_id"])
    assert [r.doc_id for r in run.orderBy("rank").collect()] == ["d1", "d2", "d3"]


def test_tfidf_fixture(spark):
    q = spark.createDataFrame([("qa", "a"), ("qbc", "b c")], "query_id string, text string")
    s = scores_of(LX.tfidf_search(docs3(spark), q, top_k=3))
    assert s[("qa", "d1")] == A(0.795961, abs=1e-6)
    assert s[("qbc", "d1")] == A(0.428046, abs=1e-6)
    assert s[("qbc", "d2")] == A(1.0, abs=1e-6)
    assert s[("qbc", "d3")] == A(0.334907, abs=1e-6)


def test_ranking_string_ids(spark):
    df = spark.createDataFrame([("q", "10", 2.0), ("q", "9", 2.0), ("q", "1", 3.0)], "query_id string, doc_id string, score double")
    run = RK.make_ranked_run(df, run_name="r")
    assert [r.doc_id for r in run.orderBy("rank").collect()] == ["1", "10", "9"]
    assert run.columns == RK.RUN_COLUMNS


def test_top_k_rows_not_rank(spark):
    df = spark.createDataFrame([("q", "a", 1), ("q", "b", 3), ("q", "c", 7)], "query_id string, doc_id string, rank int")
    assert sorted(r["rank"] for r in RK.top_k_per_query(df, 2).collect()) == [1, 3]


def test_minmax(spark):
    df = spark.createDataFrame([("q1", "a", 3.0), ("q1", "b", 1.0), ("q1", "c", 2.0), ("q2", "a", 5.0), ("q2", "b", 5.0), ("q3", "a", 7.0)],
                               "query_id string, doc_id string, score double")
    out = {(r.query_id, r.doc_id): r.score_minmax for r in RK.normalize_minmax_by_query(df).collect()}
    assert out == {("q1", "a"): 1.0, ("q1", "b"): 0.0, ("q1", "c"): 0.5, ("q2", "a"): 0.0, ("q2", "b"): 0.0, ("q3", "a"): 0.0}


def test_metrics_fixture(spark):
    run = spark.createDataFrame([("q1", "x", 3.0), ("q1", "y", 2.0), ("q1", "z", 1.0)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q1", "x", 2), ("q1", "z", 1), ("q2", "w", 1)], "query_id string, doc_id string, relevance int")
    per_q = {r.query_id: r for r in EV.per_query_metrics(run, qrels, EV.RUN_MEASURES).collect()}
    assert per_q["q1"]["P@1"] == A(1.0)
    assert per_q["q1"]["P@10"] == A(0.2)
    assert per_q["q1"]["MAP"] == A(0.833333, abs=1e-6)
    assert per_q["q1"]["nDCG@20"] == A(0.950234, abs=1e-6)
    assert per_q["q2"]["MAP"] == 0.0  # judged but missing from the run
    mean = EV.mean_metrics(run, qrels, EV.RUN_MEASURES).first()
    assert mean["MAP"] == A(0.416667, abs=1e-6)
    for v in mean.asDict().values():
        assert 0.0 <= v <= 1.0


def test_mixture_fixture(spark):
    c = spark.createDataFrame([("q", "d1", 3.0, 0.2), ("q", "d2", 1.0, 0.8)], "query_id string, doc_id string, score double, dense_score double")
    mixed, run = FU.apply_mixture(c, 0.25, top_k=2)
    m = {r.doc_id: r.mixture_score for r in mixed.collect()}
    assert m["d1"] == A(0.4) and m["d2"] == A(0.6)
    assert run.orderBy("rank").first().doc_id == "d2"


def test_lexical_features_fixture(spark):
    docs = spark.createDataFrame([("d", "b x a b")], "doc_id string, text string")
    queries = spark.createDataFrame([("q1", "b b z"), ("q2", "a b")], "query_id string, text string")
    cands = spark.createDataFrame([("q1", "d", 1.0), ("q2", "d", 1.0), ("q1", "unknown", 0.5)], "query_id string, doc_id string, score double")
    f = {(r.query_id, r.doc_id): r for r in FE.extract_lexical_features(cands, docs, queries).collect()}
    r1 = f[("q1", "d")]
    assert (r1.tf_sum, r1.tf_max, r1.matched_terms_ratio, r1.min_span, r1.doc_len, r1.query_len) == (4.0, 2.0, 0.5, 0, 4, 3)
    r2 = f[("q2", "d")]
    assert (r2.min_span, r2.matched_terms_ratio) == (3, 1.0)
    ru = f[("q1", "unknown")]
    assert ru.doc_len is None and ru.tf_sum == 0.0 and ru.idf_sum == 0.0 and ru.min_span == 0


def test_bigrams_fixture(spark):
    docs = spark.createDataFrame([("d", "the cat of hats")], "doc_id string, text string")
    b = ST.bigram_frequencies(docs, ["the", "of"])
    got = {(r.list, r.bigram) for r in b.collect()}
    assert got == {("all", "the_cat"), ("all", "cat_of"), ("all", "of_hats")}


def test_heaps_fixture(spark):
    docs = docs3(spark).withColumn("o", F.substring("doc_id", 2, 1).cast("int"))
    curve = ST.heaps_curve(docs, "o", shuffled=True)
    orig = [(r.total_words, r.unique_words) for r in curve.filter("variant = 'original'").orderBy("ord").collect()]
    assert orig == [(2, 2), (4, 3), (7, 5)]
    sh = curve.filter("variant = 'shuffled'").orderBy("ord").collect()
    assert [r.total_words for r in sh] == [2, 4, 7] and sh[-1].unique_words == 5  # same lengths, same multiset
    fit = {r.variant: r for r in ST.heaps_fit(curve).collect()}["original"]
    assert fit.beta == A(0.725680, abs=1e-6) and fit.K == A(1.173543, abs=1e-6)


def test_strip_matches_python(spark):
    from rankframe.functions.text import strip
    texts = ["  a b  ", "\x85x\u3000", "\t\n", "", "\u2003y\u200a z\u205f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(strip("t").alias("s")).collect()] == [t.strip() for t in texts]


def test_pooled_text_and_ids(spark):
    df = spark.createDataFrame([("A", "b"), ("A", "A b"), (None, "b"), ("A", " ")], "t string, c string")
    got = [r.x for r in df.select(combine_title_and_chunk("t", "c").alias("x")).collect()]
    assert got == ["A. b", "A b", "b", ""]
    assert df.select(pool_doc_id(F.lit("A"), F.lit("b"))).first()[0] == "mirage_fc2624e479d6d3d8c061f5c4e480f8a6"


def test_pool_dedupe(spark):
    from rankframe.operators.pools import build_collection
    pool = [("A", "b", 1), ("A", "b", 0), ("A", "b", 1)]
    df = spark.createDataFrame([("q", "query", "s", 1, pool)],
                               "query_id string, query string, source string, o int, doc_pool array<struct<doc_name:string,doc_chunk:string,support:int>>")
    docs, queries, qrels = build_collection(df, "o")
    assert docs.count() == 1 and queries.count() == 1
    assert sorted(r.relevance for r in qrels.collect()) == [0, 1]


def test_letor_parsers(spark):
    lines = spark.createDataFrame([("2 qid:10 1:0.5 2:0.25 # doc",), ("",)], "value string")
    r = LE.parse_letor_lines(lines).collect()
    assert len(r) == 1 and (r[0].label, r[0].group_id, r[0].features) == (2.0, 10, [0.5, 0.25])
    sp = spark.createDataFrame([("1 3:0.5 1:2 # 7",), ("0 1:1 1:3 # 8",)], "value string")
    rows = {x.group_id: x for x in LE.parse_sparse_letor_lines(sp, 4).collect()}
    assert rows[7].features == [2.0, 0.0, 0.5, 0.0] and rows[7].label == 1.0
    assert rows[8].features[0] == 3.0  # repeated index: last wins


def test_admissible_ks(spark):
    run = spark.createDataFrame([("q", str(i)) for i in range(30)] + [("p", str(i)) for i in range(40)], "query_id string, doc_id string")
    assert ST.admissible_ks(run, [10, 20, 50, 100]).first().ks == [10, 20]
    small = spark.createDataFrame([("q", str(i)) for i in range(5)], "query_id string, doc_id string")
    assert ST.admissible_ks(small, [10, 20]).first().ks == [5]


def test_grid_pivot_marginals_best(spark):
    long = spark.createDataFrame([(1.0, 0.0, 0.2), (1.0, 1.0, 0.4), (2.0, 0.0, 0.6), (2.0, 1.0, 0.4)], "k1 double, b double, m double")
    marg = {(r.k1, r.b, r.kind): r.value for r in TU.grid_marginals(long, "m").collect()}
    assert marg[(1.0, None, "row_mean")] == A(0.3) and marg[(2.0, None, "row_mean")] == A(0.5)
    assert marg[(None, 0.0, "col_mean")] == A(0.4) and marg[(None, 1.0, "col_mean")] == A(0.4)
    assert not any(k1 is None and b is None for k1, b, _ in marg)
    best = [(r.k1, r.b) for r in TU.grid_best(long, "m", 2).collect()]
    assert best == [(2.0, 0.0), (1.0, 1.0)]
    piv = TU.grid_pivot(long, "m", [0.0, 1.0]).orderBy("k1").collect()
    assert piv[0]["b=0.0"] == 0.2 and piv[1]["b=1.0"] == 0.4


def test_global_ordinal_contiguous(spark):
    from rankframe.plans.ordinals import global_ordinal, prefix_sums
    df = spark.range(0, 5000).withColumn("k", F.md5(F.col("id").cast("string")))
    o = global_ordinal(df, ["k"], out="o")
    rows = o.orderBy("o").collect()
    assert [r.o for r in rows] == list(range(1, 5001))
    assert [r.k for r in rows] == sorted(r.k for r in rows)
    ps = prefix_sums(o.select("o"), "o", {"s": F.lit(1)}, bucket_size=700)
    assert all(r.s == r.o for r in ps.collect())


def test_query_split_invariants(spark):
    from rankframe.operators.splits import grouped_split, query_split
    df = spark.createDataFrame([(str(i % 17), i) for i in range(200)], "query_id string, x int")
    s = query_split(df, share=0.1)
    per = s.groupBy("query_id").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in per)  # all rows of a query go together
    assert s.filter("split = 'vali'").select("query_id").distinct().count() == int(17 * 0.1)
    g = grouped_split(spark.createDataFrame([(str(i), f"g{i % 23}", "s" + str(i % 3)) for i in range(300)], "id string, g string, s string"), "g", "s", 0.2)
    assert g.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_grouped_split_keeps_the_share_of_every_stratum(spark):
    from rankframe.operators.splits import grouped_split
    # stratum a: one group with a third of all rows; b: even groups; c: one group only
    rows = [(f"a{0 if i < 200 else i % 40}", "a") for i in range(400)] + [(f"b{i % 20}", "b") for i in range(100)] + [("c", "c")] * 7
    df = spark.createDataFrame(rows, "g string, s string")
    got = grouped_split(df, "g", "s", 0.1)
    assert got.count() == len(rows)
    share = {r.s: (r.t, r.n) for r in got.groupBy("s").agg(F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")).collect()}
    assert share["b"] == (10, 100) and share["c"] == (0, 7)
    assert 0 < share["a"][0] < 0.2 * 400
    assert grouped_split(df.limit(0), "g", "s", 0.1).count() == 0


def test_one_exchange_of_postings(spark, tmp_path):
    """On a collection read from several files: postings meet on the document once, none on (query, doc)."""
    import re

    from rankframe.operators.lexical import _scored_pairs, tokenized_docs
    docs = spark.createDataFrame([(str(i), f"a{i % 7} b{i % 3} c") for i in range(60)], "doc_id string, text string")
    docs.repartition(6).write.parquet(str(tmp_path / "docs"))
    td = tokenized_docs(spark.read.parquet(str(tmp_path / "docs")))
    pairs, _ = _scored_pairs(td, spark.createDataFrame([("q", "a1 c")], "query_id string, text string"), (), lambda c: F.split(c, " "), 0.25)
    plan = pairs.groupBy("query_id", "doc_id", "_rf_row").agg(F.sum("tf"))._jdf.queryExecution().executedPlan().toString()
    on_docs = [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "doc_id" in x]
    assert len(on_docs) == 1 and "term" not in on_docs[0] and "query_id" not in on_docs[0], plan


def test_contract_checks(spark):
    from rankframe.sources.files import check_contract
    df = spark.createDataFrame([("1", "a"), ("1", "b")], "doc_id string, text string")
    with pytest.raises(ValueError, match="not unique"):
        check_contract(df, ["doc_id", "text"], unique="doc_id")
    with pytest.raises(ValueError, match="lacks"):
        check_contract(df, ["nope"])


def test_file_round_trips(spark, tmp_path):
    from rankframe.sources import files as FS
    (tmp_path / "docs.csv").write_text('id_right,text_right\n1,"a ""quoted""\nline"\n2,plain\n')
    d = FS.read_documents_csv(spark, str(tmp_path / "docs.csv")).orderBy("doc_id").collect()
    assert d[0].text == 'a "quoted"\nline' and d[1].doc_id == "2"
    (tmp_path / "qrels").write_text("q1\t0\td1\t2\nq1\t0\td2\t0\n")
    assert FS.read_qrels(spark, str(tmp_path / "qrels")).filter("relevance = 2").count() == 1
    (tmp_path / "stop.txt").write_text("the\n  a \n\nthe\n")
    assert sorted(r.word for r in FS.read_stopwords(spark, str(tmp_path / "stop.txt")).collect()) == ["a", "the"]
    (tmp_path / "run.res").write_text("q1 Q0 d1 0 1.5 bm\nq1  Q0 d2 1 0.5 bm\n")
    r = FS.read_trec_run(spark, str(tmp_path / "run.res"), run_name="x").orderBy("rank").collect()
    assert [x["rank"] for x in r] == [1, 2] and r[0].run_name == "x"
    run = RK.make_ranked_run(spark.createDataFrame([("q", "d", 1.0)], "query_id string, doc_id string, score double"), run_name="r")
    FS.write_trec_run(run, str(tmp_path / "out"))
    back = FS.read_trec_run(spark, str(tmp_path / "out"), rank_offset=0).first()
    assert (back.query_id, back.doc_id, back["rank"], back.score) == ("q", "d", 1, 1.0)


def test_subword_pieces(spark):
    from rankframe.operators.normalize import apply_mapping, subword_mapping
    vocab = spark.createDataFrame([(p,) for p in ["un", "##aff", "##able", "play", "##ing", "a"]], "piece string")
    words = spark.createDataFrame([("unaffable",), ("playing",), ("xyz",), ("a",)], "word string")
    m = {r.word: r.form for r in subword_mapping(words, vocab).collect()}
    assert m == {"unaffable": "un ##aff ##able", "playing": "play ##ing", "xyz": "[UNK]", "a": "a"}
    docs = spark.createDataFrame([("d", "playing a xyz")], "doc_id string, text string")
    out = apply_mapping(docs, "doc_id", subword_mapping(words, vocab)).first().text
    assert out == "play ##ing a [UNK]"


def test_metric_options(spark):
    run = spark.createDataFrame([("q1", "x", 3.0), ("q1", "y", 2.0), ("q1", "z", 1.0), ("q3", "a", 1.0)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q1", "x", 2), ("q1", "z", 1), ("q1", "w", 1), ("q2", "w", 1), ("q3", "a", 0)],
                                  "query_id string, doc_id string, relevance int")
    m = {"AP@2": EV.Measure("AP", 2), "nDCG@2": EV.Measure("nDCG", 2)}
    rel = {r.query_id: r for r in EV.per_query_metrics(run, qrels, m, ap_denominator="relevant").collect()}
    hits = {r.query_id: r for r in EV.per_query_metrics(run, qrels, m, ap_denominator="hits").collect()}
    mink = {r.query_id: r for r in EV.per_query_metrics(run, qrels, m, ap_denominator="min_k").collect()}
    assert rel["q1"]["AP@2"] == A(1 / 3) and hits["q1"]["AP@2"] == A(1.0) and mink["q1"]["AP@2"] == A(0.5)
    skip = {r.query_id: r for r in EV.per_query_metrics(run, qrels, m, empty_ndcg=None, fill_missing=False).collect()}
    assert skip["q3"]["nDCG@2"] is None and "q2" not in skip
    mean = EV.mean_metrics_skip_missing(run, qrels, m, empty_ndcg=None).first()
    assert mean["nDCG@2"] == A(skip["q1"]["nDCG@2"])  # q2 missing and q3 undefined are skipped
