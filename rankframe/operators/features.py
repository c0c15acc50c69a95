"""Lexical features of candidate pairs (L1-L7) and the learning-to-rank frame.

Per pair: tf_sum / tf_max over the query tokens (with repeats), idf_sum / idf_max (epsilon
floored BM25 idf over the whole passed collection, out-of-vocabulary = 0), matched_terms_ratio,
min_span (last minus first position of any matched term, 0 when at most one distinct term
matched), doc_len, query_len. Unknown documents get zeros and a null doc_len.

Plan: term positions are produced only for candidate documents and only for query terms
(semi-joins), then joined to (pair, query term) rows on (doc_id, term) - a key that cannot be hot.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..plans.broadcast import checked_broadcast
from .lexical import bm25_idf, build_index, query_terms, tokenized_docs
from .ranking import group_ordinals, normalize_minmax_by_query

PAIR_FEATURES = ["tf_sum", "tf_max", "idf_sum", "idf_max", "matched_terms_ratio", "min_span"]
# The LTR feature columns, in order.
FEATURE_COLS = (
    "bm25_norm", "dense_score",
    "tf_sum", "tf_max", "idf_sum", "idf_max",
    "doc_len", "query_len", "matched_terms_ratio", "min_span",
)


def extract_lexical_features(scored: DataFrame, docs: DataFrame, queries: DataFrame, epsilon: float = 0.25, tokenizer=tokenize) -> DataFrame:
    """``scored`` plus doc_len, query_len and the six pair features."""
    cands = scored.withColumn("query_id", F.col("query_id").cast("string")).withColumn("doc_id", F.col("doc_id").cast("string"))
    pairs = cands.select("query_id", "doc_id").distinct()  # repeated pairs must not fan out
    td = tokenized_docs(docs, (), tokenizer)
    idf, _ = bm25_idf(build_index(td), epsilon)
    qt = query_terms(queries, (), tokenizer)  # (query_id, term, qtf)
    qt_idf = qt.join(idf.select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    per_q = qt_idf.groupBy("query_id").agg(
        F.sum("qtf").alias("query_len"),
        F.sum(F.col("qtf") * F.col("idf")).alias("idf_sum"),
        F.max("idf").alias("idf_max"),
        F.count(F.lit(1)).alias("_nq"),
    )
    cand_docs = td.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = checked_broadcast(qt.select("term").distinct())
    occ = (
        cand_docs.select("doc_id", F.posexplode_outer("tokens").alias("pos", "term"))
        .filter(F.col("term").isNotNull())
        .join(wanted, "term", "left_semi")
    )
    pair_terms = pairs.join(qt, "query_id")  # (query_id, doc_id, term, qtf)
    hits = (
        pair_terms.join(occ, ["doc_id", "term"])
        .groupBy("query_id", "doc_id", "term")
        .agg(F.first("qtf").alias("qtf"), F.count(F.lit(1)).alias("tf"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    )
    per_pair = hits.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("qtf") * F.col("tf")).alias("tf_sum"),
        F.max("tf").alias("tf_max"),
        F.count(F.lit(1)).alias("_matched"),
        (F.max("p1") - F.min("p0")).alias("_span"),
    )
    lens = cand_docs.select("doc_id", F.col("dl").alias("doc_len"))
    feats = (
        pairs.join(per_pair, ["query_id", "doc_id"], "left")
        .join(per_q, "query_id", "left")
        .join(lens, "doc_id", "left")
        .select(
            "query_id", "doc_id", "doc_len",
            F.col("doc_len").isNotNull().alias("_k"),
            F.coalesce("tf_sum", F.lit(0)).cast("double").alias("tf_sum"),
            F.coalesce("tf_max", F.lit(0)).cast("double").alias("tf_max"),
            F.coalesce("idf_sum", F.lit(0.0)).alias("idf_sum"),
            F.coalesce("idf_max", F.lit(0.0)).alias("idf_max"),
            F.when(F.col("_nq") > 0, F.coalesce("_matched", F.lit(0)) / F.col("_nq")).otherwise(F.lit(0.0)).alias("matched_terms_ratio"),
            F.when(F.col("_matched") > 1, F.col("_span")).otherwise(F.lit(0)).cast("int").alias("min_span"),
        )
    )
    zero = {c: (F.lit(0) if c == "min_span" else F.lit(0.0)) for c in PAIR_FEATURES}
    feats = feats.select("query_id", "doc_id", "doc_len", *[F.when(F.col("_k"), F.col(c)).otherwise(zero[c]).alias(c) for c in PAIR_FEATURES])
    qlen = qt.groupBy("query_id").agg(F.sum("qtf").cast("int").alias("query_len"))
    base = cands.drop(*[c for c in ("doc_len", "query_len", *PAIR_FEATURES) if c in cands.columns])
    return (
        base.join(qlen, "query_id", "left")
        .withColumn("query_len", F.coalesce("query_len", F.lit(0)))
        .join(feats, ["query_id", "doc_id"], "left")
    )


def ltr_frame(
    scored: DataFrame,
    qrels: DataFrame | None = None,
    feature_cols: Sequence[str] = FEATURE_COLS,
) -> DataFrame:
    """bm25_norm (W4), relevance from qrels (J2, missing -> 0), dense group ordinals of the
    sorted query ids (W5), ``features ARRAY<FLOAT>`` in ``feature_cols`` order (null -> 0)."""
    df = normalize_minmax_by_query(scored, "score", "bm25_norm")
    if qrels is not None:
        q = qrels.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), "relevance")
        q = q.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
        df = df.join(q, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    df = group_ordinals(df, "query_id", "group_id")
    feats = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in feature_cols])
    cols = ["group_id", "query_id", "doc_id"] + (["relevance"] if qrels is not None else [])
    return df.select(*cols, feats.alias("features"))
