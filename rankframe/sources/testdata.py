"""Adapters from the driver's parquet tables to the retrieval data model.

* documents -> docs ``doc_id STRING, title STRING, text STRING`` (title = ``source``)
* benchmark -> queries ``query_id STRING, text STRING``
* qrels are derived from the two (``derive_qrels``)
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import explode_tokens, runs_of, tokenize
from ..plans.broadcast import checked_broadcast

# A short English function-word list used as the stopword set.
STOPWORDS = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been",
    "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he",
    "her", "his", "i", "if", "in", "into", "is", "it", "its", "may", "more", "most", "no", "not",
    "of", "on", "or", "other", "our", "she", "so", "some", "such", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "those", "to", "up", "was", "we",
    "were", "what", "when", "which", "who", "will", "with", "would", "you", "your",
]


def balanced(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a table read from only a few files over all cores.

    Parquet splits at row-group boundaries, so a table stored as one large row group is read
    by a single task. When the table has fewer input files than the cluster has cores (a small
    table), a repartition costs little and parallelises the tokenisation; hashing on ``key``
    (the document id) also tells Spark the rows are clustered by it, so per-document
    aggregations downstream need no exchange, as with a collection stored bucketed by id.
    Large tables arrive in many files and are left alone: their text is never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores:
        return df.repartition(cores, key) if key else df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("source").alias("title"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return balanced(docs, "doc_id")


def load_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def stopword_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")


def derive_qrels(docs: DataFrame, queries: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Judgements: 1 = the doc holds at least ``min_share`` of the query's distinct terms,
    2 = it also contains the whole query text. Other pairs are unjudged.

    Exact without scoring all pairs (prefix filtering): with n distinct query terms and
    t = ceil(min_share * n) needed, at most n - t terms are missing from a qualifying doc, so it must contain
    ``m`` of the query's ``n - t + m`` rarest terms (m = 3, or t if less). Candidates come from an equi-join on those rare terms only, so a
    term present in every document never fans out; they are then checked row-wise against the
    documents with the (size-checked) candidate table broadcast, so the collection is not shuffled.
    """
    q = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("text").alias("q_text"),
        F.array_distinct(tokenize("text")).alias("q_terms"),
    ).withColumn("n", F.size("q_terms")).withColumn("t", F.ceil(F.col("n") * F.lit(min_share)).cast("int")).withColumn("m", F.greatest(F.lit(1), F.least(F.lit(3), "t")))
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").withColumn(
        "d_terms", F.array_distinct(tokenize("text"))
    )
    dt = d.select("doc_id", explode_tokens("d_terms").alias("term")).filter(F.col("term").isNotNull())
    # pass 1: document frequencies (map-side partial counts), reduced to the query-side prefix
    qt = q.filter(F.col("n") > 0).select("query_id", "n", "t", "m", F.explode("q_terms").alias("term"))
    dfreq = (
        dt.join(checked_broadcast(qt.select("term").distinct()), "term", "left_semi")  # only query terms need a df
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    qt = qt.join(dfreq, "term", "left").fillna(0, ["df"])
    w = Window.partitionBy("query_id").orderBy(F.col("df").asc(), F.col("term").asc())
    prefix = (
        qt.withColumn("_pos", F.row_number().over(w))
        .filter(F.col("_pos") <= F.col("n") - F.col("t") + F.col("m"))
        .select("term", F.struct("query_id", "m").alias("asked"))
        .checkpoint(eager=True)  # small: at most n - t + 3 terms per query
    )
    # pass 2: candidate pairs from the rare prefix terms only, as two ids; the queries' texts and terms meet them in the check, so none is
    # written or shuffled once per candidate. A document lists a query once for each of its rare terms; m of them make a candidate
    listed = dt.join(checked_broadcast(prefix), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list("asked")).alias("asked"))
    met = runs_of(F.col("asked"), lambda a, b: a == b, lambda s, i, n: F.when(n >= F.get(s, i - 1)["m"], F.get(s, i - 1)["query_id"]))
    cands = listed.select("doc_id", F.array_distinct(F.filter(met, lambda x: x.isNotNull())).alias("q_ids")).filter(F.size("q_ids") > 0).checkpoint(eager=True)
    # pass 3: exact check row by row, the candidate table broadcast after its size check
    asked = checked_broadcast(q.select("query_id", "q_text", "q_terms", "t"))
    checked = (
        d.join(checked_broadcast(cands), "doc_id").withColumn("query_id", F.explode("q_ids")).drop("q_ids").join(asked, "query_id")
        .withColumn("shared", F.size(F.array_intersect("d_terms", "q_terms")))
    )
    out = checked.filter(F.col("shared") >= F.col("t")).select(
        "query_id",
        "doc_id",
        F.when(F.col("text").contains(F.col("q_text")), F.lit(2)).otherwise(F.lit(1)).alias("relevance"),
    )
    # judgements are small and read by every evaluation branch: materialise once
    return out.checkpoint(eager=True)
