"""Grades, labels and scores outside the common range; runs without judged queries; stores."""
import pytest

from rankframe.operators import dense, evaluation, fusion, ltr, normalize, tuning
from rankframe.operators.lexical import bm25_search


def _run(spark, rows):
    return spark.createDataFrame([(q, d, s, n) for q, d, s, n in rows], "query_id string, doc_id string, score double, run_name string")


def test_grade_three_counts(spark):
    qrels = spark.createDataFrame([("q", "a", 3)], "query_id string, doc_id string, relevance int")
    m = evaluation.mean_metrics(_run(spark, [("q", "a", 1.0, "r")]), qrels).first()
    assert m["P@1"] == 1 and m["nDCG@20"] == pytest.approx(1)


def test_high_grades_and_half_labels(spark):
    scored = spark.createDataFrame([(1, 1, 5.0, 0.9), (1, 2, 4.0, 0.8)], "group_id long, row_id long, label double, score double")
    assert ltr.ltr_metrics(scored).first()["NDCG@10"] == pytest.approx(1)
    half = spark.createDataFrame([(1, 1, 0.5, 0.9), (1, 2, 0.0, 0.8)], "group_id long, row_id long, label double, score double")
    m = ltr.ltr_metrics(half).first()
    assert (m["Precision@10"], m["MAP@10"], m["NDCG@10"]) == pytest.approx((0.1, 1, 1))


def test_runs_without_judged_queries_are_zero(spark):
    qrels = spark.createDataFrame([("q", "a", 1)], "query_id string, doc_id string, relevance int")
    runs = _run(spark, [("q", "a", 1.0, "good"), ("x", "a", 1.0, "other")])
    got = {r.run_name: r["P@1"] for r in evaluation.evaluate_runs(runs, qrels).collect()}
    assert got == {"good": 1.0, "other": 0.0}
    assert evaluation.evaluate_run(runs.filter("run_name = 'other'"), qrels).first()["P@1"] == 0


def test_split_mean_is_the_mean_of_its_queries(spark):
    qrels = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], "query_id string, doc_id string, relevance int")
    part = qrels.filter("query_id <> 'c'")
    run = _run(spark, [("a", "1", 1.0, "r")])
    per = evaluation.per_query_metrics(run, part).collect()
    assert evaluation.mean_metrics(run, part).first()["P@1"] == sum(r["P@1"] for r in per) / len(per) == 0.5


def test_grid_fills_zeros_when_idf_is_negative(spark):
    docs = spark.createDataFrame([("1", "", "a c"), ("2", "", "b c"), ("3", "", "a b c")], "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q", "c")], "query_id string, text string")
    one = {r.doc_id for r in bm25_search(docs, queries, top_k=3).collect()}
    grid = tuning.bm25_grid_runs(docs, queries, [(1.5, 0.75), (1.2, 0.0)], top_k=3).collect()
    assert len(one) == 3 and len(grid) == 6


def test_subwords_have_no_caps(spark):
    vocab = spark.createDataFrame([("un",), ("##aff",), ("##able",), ("a",), ("##a",), ("##ab",)], "piece string")
    words = spark.createDataFrame([("unaffable",), ("a" * 150,), ("unx",), ("",), ("aab",)], "word string")
    got = {r.word: r.form for r in normalize.subword_mapping(words, vocab).collect()}
    assert got["unaffable"] == "un ##aff ##able" and got["unx"] == "[UNK]" and got[""] == "" and got["aab"] == "a ##ab"
    assert got["a" * 150] == " ".join(["a"] + ["##a"] * 149)


def test_frequent_pieces_count_words_once(spark):
    words = spark.createDataFrame([("aab",), ("aab",), ("abc",), ("",), (None,)], "word string")
    pieces = lambda least: sorted(r.piece for r in normalize.frequent_pieces(words, 2, least).collect())
    assert pieces(2) == ["##b", "a"]
    assert pieces(1) == sorted(["a", "aa", "ab", "##a", "##ab", "##b", "##bc", "##c"])
    assert pieces(3) == []


def test_embedding_store_keeps_null_and_repeated_items(spark, tmp_path):
    items = spark.createDataFrame([("1", "x y"), ("1", "x y"), ("2", None), ("3|z", "w")], "id string, text string")
    compute = lambda df: dense.hashed_embeddings(df, "id", "text", 8)
    for _ in range(2):
        got = dense.cached_embeddings(str(tmp_path / "store"), items, "m", "doc", compute).collect()
        assert sorted(r.id for r in got) == ["1", "1", "2", "3|z"]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_unreadable_model_is_not_overwritten(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "junk").write_text("x")
    with pytest.raises(Exception):
        ltr.save_or_load(lambda: pytest.fail("refitted"), str(tmp_path / "m"))
    assert (tmp_path / "m" / "junk").exists()


def test_no_alpha_raises(spark):
    with pytest.raises(ValueError):
        fusion.best_alpha(spark.createDataFrame([], "alpha double, `nDCG@20` double"))
