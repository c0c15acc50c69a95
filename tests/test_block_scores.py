"""Scores added up in arrays by the documents of a task equal the sums of joined rows, and only rows near a query's first ones leave a task."""
import pytest
from pyspark.sql import functions as F

from rankframe.operators import block_scores as B
from rankframe.operators import lexical


def tables(spark, keyed, ids=120):
    words = "concat_ws(' ', 'w' || id % 7, 'w' || id % 5, 'w' || id % 7, 'x' || id, if(id % 9 = 0, null, 'common'))"
    docs = spark.range(120).selectExpr(f"cast(id % {ids} as string) doc_id", f"if(id = 50, null, {words}) text").repartition(3)
    queries = spark.range(6).selectExpr("cast(id as string) query_id", "concat('w', id, ' w', id + 1, ' w', id, ' nowhere common x', id) text")
    if keyed:
        docs, queries = (df.withColumn("variant", F.explode(F.array(*map(F.lit, names)))) for df, names in ((docs, "abc"), (queries, "abd")))
    return docs, queries, ["variant"] if keyed else []


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("search", [lexical.bm25_search, lexical.tfidf_search])
def test_arrays_equal_joins(spark, monkeypatch, keyed, search):
    docs, queries, keys = tables(spark, keyed)
    made, plain = [], lexical.block_scores
    monkeypatch.setattr(lexical, "block_scores", lambda *a: made.append(plain(*a)) or made[-1])
    run = lambda k: sorted(map(tuple, search(docs, queries, top_k=k, collection_cols=keys, score_digits=6).collect()))
    got = {k: run(k) for k in (1, 7, 300)}
    monkeypatch.setattr(B, "SLICE", 40)
    small = run(7)
    assert len(made) == 4 and got[7] == small
    monkeypatch.setattr(lexical, "fits", lambda *a: False)
    assert got == {k: run(k) for k in got} and len(made) == 4


def test_rows_far_from_the_first_stay_in_the_task(spark):
    docs, queries, _ = tables(spark, False)
    every, _ = lexical.bm25_scores(docs, queries)
    first, nonnegative = lexical.bm25_scores(docs, queries, top_k=2, score_digits=6)
    assert nonnegative and every.count() > 600 and first.count() < every.count() / 2


def test_repeated_ids_meet_in_the_sum(spark, monkeypatch):
    docs, queries, _ = tables(spark, False, ids=110)
    run = lambda: sorted(map(tuple, lexical.bm25_search(docs, queries, top_k=9, score_digits=6).collect()))
    got = run()
    monkeypatch.setattr(lexical, "fits", lambda *a: False)
    assert got == run()
