"""The (query, document) pairs of a search are dealt over tasks by their number, not by the bytes of the postings."""
import re

import pytest
from pyspark.sql import functions as F

from rankframe.operators import lexical, tuning


def _tables(spark, keyed=False):
    docs = spark.range(120).selectExpr("cast(id % 110 as string) doc_id", "concat_ws(' ', 'w' || id % 7, 'w' || id % 5, 'w' || id % 7, 'x' || id) text")
    queries = spark.range(6).selectExpr("cast(id as string) query_id", "concat('w', id, ' w', id + 1, ' w', id) text")
    if keyed:
        docs, queries = (df.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b")))) for df in (docs, queries))
    return docs, queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keyed", [False, True])
def test_search_by_many_tasks_equals_few(spark, monkeypatch, keyed):
    docs, queries = _tables(spark, keyed)
    keys = ["variant"] if keyed else []
    search = lambda: sorted(map(tuple, lexical.bm25_search(docs, queries, top_k=8, collection_cols=keys, score_digits=6).collect()))
    few = search()
    monkeypatch.setattr(lexical, "PAIRS_PER_TASK", 20, raising=False)
    assert search() == few


def test_tasks_grow_with_documents_queries_and_cells(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS_PER_TASK", 20, raising=False)
    docs, queries = _tables(spark)

    def tasks(df):
        return max([int(n) for n in re.findall(r"Exchange hashpartitioning\(doc_id[^,]*, (\d+)\), REPARTITION_BY_NUM", _plan(df))], default=0)

    scores, _ = lexical.bm25_scores(docs, queries)
    assert tasks(scores) == 120 * 6 // 20
    grid, _ = lexical._scored_pairs(lexical.tokenized_docs(docs), queries, (), lexical.tokenize, 0.25, cells=3)
    assert tasks(grid) == 3 * 120 * 6 // 20


def test_grid_by_many_tasks_equals_few(spark, monkeypatch):
    docs, queries = _tables(spark)
    run = lambda: sorted(map(tuple, tuning.bm25_grid_runs(docs, queries, [(0.6, 0.0), (1.5, 0.75)], top_k=5, score_digits=6).collect()))
    few = run()
    monkeypatch.setattr(lexical, "PAIRS_PER_TASK", 20, raising=False)
    assert run() == few
