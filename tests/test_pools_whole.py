"""The pools of the pool queries: what BM25 finds over all documents first, then the query's share of the collection."""
from pyspark.sql import functions as F

from rankframe.suite import queries as Q

SF = "/root/testdata/sf0.001"


def test_pools_hold_the_search_and_the_whole_collection(spark):
    entries = Q.PL.pool_entries(Q.pooled_examples(spark, SF, found=Q.POOL_FOUND), **Q.IN_PARTS).select("query_id", "pos", "doc_chunk")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("doc_chunk"))
    top = Q.bm25_search(*Q._io(spark, SF), top_k=Q.POOL_FOUND, score_digits=Q.DIGITS).join(docs, "doc_id")
    wanted = {(r.query_id, r["rank"] - 1, r.doc_chunk) for r in top.collect()}
    assert {tuple(r) for r in entries.filter(F.col("pos") < Q.POOL_FOUND).collect()} == wanted
    n = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    share = {(str(int(r.doc_id) % n), r.doc_chunk) for r in docs.collect()}
    assert share <= {(r.query_id, r.doc_chunk) for r in entries.collect()}
    firsts = [r for r in Q.grouped_split(spark, SF).collect()]
    assert len(firsts) == n


def test_group_of_an_example_is_its_best_document(spark):
    top = Q.bm25_search(*Q._io(spark, SF), top_k=1, score_digits=Q.DIGITS)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang")
    wanted = {(r.query_id, r.source or r.query_id, r.lang) for r in top.join(docs, "doc_id").collect()}
    assert {(r.query_id, r.group_key, r.source) for r in Q.grouped_split(spark, SF).collect()} == wanted
