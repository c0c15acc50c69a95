"""Registered queries: Spark plans over the driver tables, one per operator group of SURVEY §2.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame. Scores and metrics are rounded
to 6 decimals so the DuckDB twins in ``oracle.py`` can be compared value by value.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evaluation import DEFAULT_MEASURES, mean_metrics, per_query_metrics
from ..operators.lexical import bm25_search, tfidf_search
from ..sources.testdata import derive_qrels, load_docs, load_queries

QueryFn = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def _io(spark, sf):
    return load_docs(spark, sf), load_queries(spark, sf)


def bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    """R2 + W1 + zero fill: BM25 top 10 of every benchmark query over all documents."""
    docs, queries = _io(spark, sf)
    return bm25_search(docs, queries, top_k=10, run_name="bm25", score_digits=DIGITS)


def tfidf_top10(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF top 10."""
    docs, queries = _io(spark, sf)
    return tfidf_search(docs, queries, top_k=10, run_name="tfidf", score_digits=DIGITS)


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Derived judgements (prefix-filtered term join)."""
    docs, queries = _io(spark, sf)
    return derive_qrels(docs, queries)


def bm25_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Mean P@1/10/20, MAP@20, nDCG@20 of the BM25 top-100 run."""
    docs, queries = _io(spark, sf)
    run = bm25_search(docs, queries, top_k=100, run_name="bm25", score_digits=DIGITS)
    return rounded(mean_metrics(run, derive_qrels(docs, queries), DEFAULT_MEASURES))


def bm25_eval_per_query(spark: SparkSession, sf: str) -> DataFrame:
    """Per judged query (queries missing from the run count 0)."""
    docs, queries = _io(spark, sf)
    run = bm25_search(docs, queries, top_k=100, run_name="bm25", score_digits=DIGITS)
    return rounded(per_query_metrics(run, derive_qrels(docs, queries), DEFAULT_MEASURES))


QUERIES: dict[str, QueryFn] = {
    "bm25_top10": bm25_top10,
    "tfidf_top10": tfidf_top10,
    "qrels": qrels,
    "bm25_eval": bm25_eval,
    "bm25_eval_per_query": bm25_eval_per_query,
}


# ------------------------------------------------------------------ statistics
from ..operators import stats as ST  # noqa: E402
from ..sources.testdata import STOPWORDS, stopword_frame  # noqa: E402


def collection_stats(spark, sf):
    """A1: basic collection statistics."""
    return rounded(ST.collection_stats(load_docs(spark, sf)))


def term_freq(spark, sf):
    """A4 + P6: frequency list with stopword flag."""
    return ST.term_frequencies(load_docs(spark, sf), STOPWORDS, ordered=True)


def term_freq_table(spark, sf):
    """A4 + P6: the list of words without stopwords, the stopwords in a table (flag by a left join, filter by an anti join)."""
    stop = stopword_frame(spark)
    flagged = ST.term_frequencies(load_docs(spark, sf), stop, ordered=True)
    return ST.without_stopwords(flagged, stop).orderBy(F.desc("count"), "word")


def stopword_coverage(spark, sf):
    """A5."""
    return rounded(ST.stopword_coverage(load_docs(spark, sf), STOPWORDS))


def top_words(spark, sf):
    """Top-30 non-stopwords and stoplist candidates."""
    return ST.top_words(load_docs(spark, sf), STOPWORDS)


def zipf(spark, sf):
    """Zipf ranks and ideal curve, with and without stopwords (ideal = one exact division,
    left unrounded)."""
    return ST.zipf(load_docs(spark, sf), STOPWORDS)


def bigrams(spark, sf):
    """A11 + W7: bigram frequency lists."""
    return ST.bigram_frequencies(load_docs(spark, sf), STOPWORDS)


def _docs_in_order(spark, sf):
    return load_docs(spark, sf).withColumn("doc_no", F.col("doc_id").cast("long"))


def heaps(spark, sf):
    """A8 + A9 + W6: Heaps curves of the collection and of its seeded shuffle."""
    return ST.heaps_curve(_docs_in_order(spark, sf), "doc_no", seed=42)


def heaps_fit(spark, sf):
    """A10: Heaps fit (beta, K) per variant."""
    return rounded(ST.heaps_fit(ST.heaps_curve(_docs_in_order(spark, sf), "doc_no", seed=42)))


def query_stats(spark, sf):
    """A2 + A3 + J1 + P4: query statistics summary."""
    docs, queries = _io(spark, sf)
    return rounded(ST.query_stats(queries, derive_qrels(docs, queries))[0])


def query_stats_per_query(spark, sf):
    """A2: per-query length and distinct relevant documents (0 when none)."""
    docs, queries = _io(spark, sf)
    return ST.query_stats(queries, derive_qrels(docs, queries))[1]


QUERIES.update({
    "collection_stats": collection_stats,
    "term_freq": term_freq,
    "term_freq_table": term_freq_table,
    "stopword_coverage": stopword_coverage,
    "top_words": top_words,
    "zipf": zipf,
    "bigrams": bigrams,
    "heaps": heaps,
    "heaps_fit": heaps_fit,
    "query_stats": query_stats,
    "query_stats_per_query": query_stats_per_query,
})


# ------------------------------------------------------------------ grids and splits
from ..operators import splits as SP  # noqa: E402
from ..operators import tuning as TU  # noqa: E402
from ..operators.evaluation import RUN_MEASURES, Measure, evaluate_runs  # noqa: E402

# The BM25 grid of the tuning experiment.
GRID_K1 = [0.6, 0.9, 1.2, 1.5, 1.8, 2.1]
GRID_B = [0.0, 0.25, 0.5, 0.75, 1.0]
GRID = [(k1, b) for k1 in GRID_K1 for b in GRID_B]


def _split_queries(spark, sf):
    docs, queries = _io(spark, sf)
    return docs, SP.query_split(queries, "query_id", share=0.1, seed=42)


def query_split(spark, sf):
    """C6 + U4: query-level validation split (md5-seeded)."""
    _, q = _split_queries(spark, sf)
    return q.select("query_id", "split")


def _judged(docs, queries, part, qrels=None):
    """Judgements of the queries in ``part`` only: a split's means are over its own judged queries."""
    found = derive_qrels(docs, queries) if qrels is None else qrels
    return found.join(part.select("query_id"), "query_id", "left_semi")


def _grid_long(spark, sf, qrels=None):
    docs, q = _split_queries(spark, sf)
    vali = q.filter(F.col("split") == "vali").drop("split")
    return TU.grid_search_bm25(docs, vali, _judged(docs, q, vali, qrels), GRID, "P@10", Measure("P", 10), top_k=10, score_digits=DIGITS)


def bm25_grid(spark, sf):
    """R5 + J10: P@10 of every (k1, b) cell on the validation queries."""
    return rounded(_grid_long(spark, sf))


def bm25_grid_lemmatized(spark, sf):
    """R5 on the lemmatised text: the same grid over the rewritten collection and validation queries."""
    from ..operators import normalize as NZ

    docs, q = _split_queries(spark, sf)
    dv, qv = (df.filter("variant = 'lemmatized'").drop("variant") for df in NZ.text_variants(docs, q))
    vali = q.filter(F.col("split") == "vali").drop("split")
    found = TU.grid_search_bm25(dv, qv.join(vali.select("query_id"), "query_id", "left_semi"), _judged(docs, q, vali), GRID, "P@10", Measure("P", 10), top_k=10,
                                score_digits=DIGITS)
    return rounded(found).orderBy(F.desc("P@10"), "k1", "b")


def bm25_grid_pivot(spark, sf):
    """Grid pivot, rounded to 4 decimals."""
    return TU.grid_pivot(_grid_long(spark, sf), "P@10", GRID_B)


def bm25_grid_marginals(spark, sf):
    """Cells, row means and column means (grouping sets)."""
    return rounded(TU.grid_marginals(_grid_long(spark, sf), "P@10"))


def bm25_grid_best(spark, sf):
    """Best two cells."""
    return TU.grid_best(_grid_long(spark, sf), "P@10", 2)


def bm25_tuned_eval(spark, sf):
    """R6 + E8: the best two cells re-run on the training (non-validation) queries, evaluated."""
    docs, q = _split_queries(spark, sf)
    qr = derive_qrels(docs, q)  # of both splits, derived once
    best = TU.grid_best(_grid_long(spark, sf, qr), "P@10", 2)
    test = q.filter(F.col("split") == "train").drop("split")
    runs = TU.tuned_runs(docs, test, best, top_k=RUN_K, score_digits=DIGITS)
    return rounded(evaluate_runs(runs, _judged(docs, q, test, qr), RUN_MEASURES, digits=4))


QUERIES.update({
    "query_split": query_split,
    "bm25_grid": bm25_grid,
    "bm25_grid_lemmatized": bm25_grid_lemmatized,
    "bm25_grid_pivot": bm25_grid_pivot,
    "bm25_grid_marginals": bm25_grid_marginals,
    "bm25_grid_best": bm25_grid_best,
    "bm25_tuned_eval": bm25_tuned_eval,
})


# ------------------------------------------------------------------ dense, re-ranking, fusion
from ..operators import dense as DN  # noqa: E402
from ..operators import fusion as FU  # noqa: E402
from ..operators.ranking import top_k_per_query  # noqa: E402

EMBED_DIM = 64
# Re-rank depths and the "encoders" of the dense sweep (hashed dimensions).
RERANK_KS = [10, 20, 50, 100]
SWEEP_DIMS = [32, 64]
# Depth of the candidate lists and of the compared runs.
CANDIDATE_K = 1000
RUN_K = 1000


def _vecs(spark, sf, dim=EMBED_DIM):
    docs, queries = _io(spark, sf)
    dv = DN.hashed_embeddings(docs, "doc_id", "text", dim).withColumnRenamed("id", "doc_id")
    qv = DN.hashed_embeddings(queries, "query_id", "text", dim).withColumnRenamed("id", "query_id")
    return docs, queries, dv, qv


def dense_embed(spark, sf):
    """Hashed bag-of-words embeddings of all documents (unit length, float32)."""
    return rounded(DN.hashed_embeddings(load_docs(spark, sf), "doc_id", "text", EMBED_DIM))


def dense_embed_model(spark, sf):
    """R7 + X4: the same vectors from a batch encoder, loaded once per worker and fed by length."""
    return rounded(DN.embed(load_docs(spark, sf), "doc_id", "text", lambda: DN.hashed_encoder(EMBED_DIM), EMBED_DIM, name=f"hashed-{EMBED_DIM}"))


def cross_pairs_model(spark, sf):
    """R10 + X4 + J3: every BM25 top-20 candidate pair scored by a batch pair model."""
    docs, queries, _, _, run = _candidates(spark, sf, 20)
    return rounded(DN.score_pairs_cross(run, queries, docs, scorer=DN.pair_scorer(DN.overlap_pair_model)).select("query_id", "doc_id", "rank", "rerank_score"))


def contract_checks(spark, sf):
    """The canonical documents and queries, checked by the jobs that write them: rows, nulls and repeated ids per column."""
    import uuid

    from ..sources.files import write_checked

    folder = f"{ensure_checkpoint_dir(spark)}/checked-{uuid.uuid4().hex}"
    raw = {"documents": ("doc_id", table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")),
           "queries": ("query_id", table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text"))}
    found = [write_checked(df, f"{folder}/{name}", df.columns, unique=key, fail=False).select(F.lit(name).alias("table"), "*") for name, (key, df) in raw.items()]
    return found[0].unionByName(found[1])


def dense_top10(spark, sf):
    """Exact dense top 10 per query over all documents."""
    _, _, dv, qv = _vecs(spark, sf)
    return DN.dense_search(dv, qv, top_k=10, run_name="dense", score_digits=DIGITS)


def _candidates(spark, sf, k=50):
    docs, queries = _io(spark, sf)
    # a candidate run is a small table (k rows per query) read by several jobs: written once,
    # like a prebuilt run file
    run = bm25_search(docs, queries, top_k=k, run_name="bm25", score_digits=DIGITS).checkpoint(eager=True)
    # only the texts to be scored are embedded
    texts = docs.join(run.select("doc_id").distinct(), "doc_id", "left_semi")
    dv = DN.hashed_embeddings(texts, "doc_id", "text", EMBED_DIM).withColumnRenamed("id", "doc_id")
    qv = DN.hashed_embeddings(queries, "query_id", "text", EMBED_DIM).withColumnRenamed("id", "query_id")
    return docs, queries, dv, qv, run


def biencoder_pairs(spark, sf):
    """R9 + J4 + J5: dense score of every BM25 top-20 candidate pair."""
    _, _, dv, qv, run = _candidates(spark, sf, 20)
    return rounded(DN.score_pairs_biencoder(run, qv, dv))


def rerank_sweep(spark, sf):
    """R10 + R11 + A18 + W2 + J3: candidates scored once, re-ranked and evaluated per depth."""
    docs, queries, _, _, run = _candidates(spark, sf, 100)
    from ..operators.stats import admissible_ks
    ks = admissible_ks(run, RERANK_KS).first()["ks"]
    cands = top_k_per_query(run, max(ks))
    scored = DN.score_pairs_cross(cands, queries, docs).withColumn("rerank_score", F.round("rerank_score", DIGITS))
    reranked = DN.rerank_sweep(scored, ks)
    qr = derive_qrels(docs, queries)
    return rounded(mean_metrics(reranked, qr, DEFAULT_MEASURES, group_cols=["k"]))


def dense_sweep(spark, sf):
    """Dense runs of both collections (documents, whole pools) with each encoder (hashed dimension), in one search and one evaluation keyed by
    (dataset, model); by dataset, best nDCG first."""
    both = datasets(spark, sf, bm25=False)
    vecs = lambda df, key: [
        DN.hashed_embeddings(df, key, "text", dim).select(F.col("id").alias(key), "embedding", F.lit(f"hash{dim}").alias("model")) for dim in SWEEP_DIMS]
    dv, qv = (vecs(both["docs"], "doc_id"), vecs(both["queries"], "query_id"))
    # a document of another collection or encoder is never met: the key is (dataset, model)
    keyed = lambda parts, ids, key: parts[0].unionByName(parts[1]).join(ids, key).withColumn("key", F.concat_ws("/", "dataset", "model"))
    run = DN.dense_search(keyed(dv, both["docs"].select("doc_id", "dataset"), "doc_id"), keyed(qv, both["queries"].select("query_id", "dataset"), "query_id"),
                          top_k=20, run_name="dense", score_digits=DIGITS, group_col="key")
    run = run.withColumns({"dataset": F.substring_index("key", "/", 1), "model": F.substring_index("key", "/", -1)})
    found = mean_metrics(run, both["qrels"], DEFAULT_MEASURES, group_cols=["dataset", "model"], judged_cols=["dataset"])
    return rounded(found.select("dataset", "model", *DEFAULT_MEASURES)).orderBy("dataset", F.desc("nDCG@20"), "model")


def datasets(spark, sf, bm25: bool = True):
    """Both collections under one ``dataset`` key: ``docs`` (dataset, doc_id, text), ``queries`` (dataset, query_id, text, split), ``qrels`` and, on request,
    the BM25 ``run`` (1000 candidates per query in ``documents``, each query's own pool in ``pools``). Ids carry their dataset, so
    every join on them stays inside it."""
    docs, queries = _io(spark, sf)
    split = SP.query_split(queries, "query_id", 0.1, 42).select("query_id", "split")
    judged = derive_qrels(docs, queries)
    pooled = pooled_examples(spark, sf, judged=judged)
    pdocs, _, pqrels = PL.build_collection(pooled, "ex_ord", **IN_PARTS)
    pdocs = pdocs.checkpoint()  # read by every encoder, search and feature: its first occurrences are found once
    name = lambda ds, key: F.concat(F.lit(f"{ds}:"), F.col(key))
    own = lambda df, ds, *keys: df.withColumns({"dataset": F.lit(ds), **{k: name(ds, k) for k in keys}})
    split_queries = queries.join(split, "query_id")
    out = {
        "docs": own(docs.select("doc_id", "text"), "documents", "doc_id").unionByName(own(pdocs.select("doc_id", "text"), "pools", "doc_id")),
        "queries": own(split_queries, "documents", "query_id").unionByName(own(split_queries, "pools", "query_id")),
        "qrels": own(judged, "documents", "query_id", "doc_id").unionByName(own(pqrels, "pools", "query_id", "doc_id")).checkpoint(),
    }
    if bm25:
        run = bm25_search(docs, queries, top_k=CANDIDATE_K, run_name="bm25", score_digits=DIGITS)
        pool_run = PL.pooled_bm25(pooled, top_k=100, score_digits=DIGITS, **IN_PARTS)
        out["run"] = own(run, "documents", "query_id", "doc_id").unionByName(own(pool_run, "pools", "query_id", "doc_id")).checkpoint()
    return out


def scored_datasets(spark, sf):
    """``datasets`` with the dense score of every candidate (only texts and queries of candidates are embedded), the split beside it."""
    both = datasets(spark, sf)
    run = both["run"]
    texts = both["docs"].join(run.select("doc_id").distinct(), "doc_id", "left_semi")
    dv = DN.hashed_embeddings(texts, "doc_id", "text", EMBED_DIM).withColumnRenamed("id", "doc_id")
    qv = DN.hashed_embeddings(both["queries"], "query_id", "text", EMBED_DIM).withColumnRenamed("id", "query_id")
    scored = DN.score_pairs_biencoder(run, qv, dv).withColumn("dense_score", F.round("dense_score", DIGITS))
    both["scored"] = scored.join(both["queries"].select("query_id", "split"), "query_id").checkpoint()
    both["qrels"] = both["qrels"].join(both["queries"].select("query_id", "split"), "query_id")
    return both


def _method_rows(runs, qrels):
    """One report row per (dataset, method) of a union of runs, in one evaluation."""
    union = None
    for method, run in runs:
        part = run.select("dataset", F.lit(method).alias("method"), "query_id", "doc_id", "score")
        union = part if union is None else union.unionByName(part)
    found = mean_metrics(union, qrels, DEFAULT_MEASURES, group_cols=["dataset", "method"], judged_cols=["dataset"])
    return found.select("dataset", "method", *DEFAULT_MEASURES)


def _tuned_mixture(both):
    """F2 on the training queries of ``documents``, F1 on the test queries of both: (alpha, run)."""
    train = "dataset = 'documents' and split = 'train'"
    alpha = FU.best_alpha(FU.tune_alpha(both["scored"].filter(train), both["qrels"].filter(train), score_digits=DIGITS))
    _, run = FU.apply_mixture(both["scored"].filter("split = 'vali'"), alpha, top_k=20, run_name="mixture", score_digits=DIGITS)
    return alpha, run.withColumn("dataset", F.substring_index("query_id", ":", 1))


def _scored_candidates(spark, sf):
    docs, queries, dv, qv, run = _candidates(spark, sf, CANDIDATE_K)
    split = SP.query_split(queries, "query_id", 0.1, 42).select("query_id", "split")
    scored = DN.score_pairs_biencoder(run, qv, dv).withColumn("dense_score", F.round("dense_score", DIGITS)).join(split, "query_id")
    # scored once, read by the tuning and by every test run
    return docs, queries, scored.checkpoint(eager=True), derive_qrels(docs, queries).join(split, "query_id")


def mixture_tune(spark, sf):
    """F2 + W4: nDCG@20 per alpha on the training queries."""
    _, _, scored, qr = _scored_candidates(spark, sf)
    return rounded(FU.tune_alpha(scored.filter("split = 'train'"), qr.filter("split = 'train'"), score_digits=DIGITS))


def mixture_report(spark, sf):
    """F1 + F3 + E11 + U1: BM25@20, dense@20 and mixture@20 (alpha tuned on the training queries of ``documents``) on the test queries of both
    collections, one report row per (dataset, method)."""
    both = scored_datasets(spark, sf)
    alpha, mix_run = _tuned_mixture(both)
    test = both["scored"].filter("split = 'vali'")
    dense_run = make_ranked_run(test, "dense_score", "dense", 20, partition_cols=["dataset"])
    runs = [("BM25", top_k_per_query(test, 20)), ("Dense", dense_run), (f"Mixture a={alpha:.2f}", mix_run)]
    return rounded(_method_rows(runs, both["qrels"].filter("split = 'vali'"))).orderBy("dataset", "method")


from ..operators.ranking import make_ranked_run  # noqa: E402

QUERIES.update({
    "dense_embed": dense_embed,
    "dense_embed_model": dense_embed_model,
    "cross_pairs_model": cross_pairs_model,
    "contract_checks": contract_checks,
    "dense_top10": dense_top10,
    "biencoder_pairs": biencoder_pairs,
    "rerank_sweep": rerank_sweep,
    "dense_sweep": dense_sweep,
    "mixture_tune": mixture_tune,
    "mixture_report": mixture_report,
})


# ------------------------------------------------------------------ lexical features, LTR frame
from ..operators import features as FE  # noqa: E402


def _feature_candidates(spark, sf):
    docs, queries, dv, qv, run = _candidates(spark, sf, 20)
    scored = DN.score_pairs_biencoder(run, qv, dv).withColumn("dense_score", F.round("dense_score", DIGITS))
    return docs, queries, FE.extract_lexical_features(scored, docs, queries)


def lexical_features(spark, sf):
    """L1-L6 + J6 + J7: lexical features of every BM25 top-20 candidate."""
    _, _, f = _feature_candidates(spark, sf)
    return rounded(f.select("query_id", "doc_id", "doc_len", "query_len", *FE.PAIR_FEATURES))


def ltr_frame(spark, sf):
    """L7 + W4 + W5 + J2 + P7: the learning-to-rank frame (features array, label, group ids)."""
    docs, queries, f = _feature_candidates(spark, sf)
    fr = FE.ltr_frame(f, derive_qrels(docs, queries))
    return fr.select("group_id", "query_id", "doc_id", "relevance", (F.col("relevance") > 0).cast("int").alias("binary_label"),
                     F.transform("features", lambda x: F.round(x.cast("double"), 4)).alias("features"))


QUERIES.update({"lexical_features": lexical_features, "ltr_frame": ltr_frame})


# ------------------------------------------------------------------ LETOR and learning to rank
from ..operators import ltr as LT  # noqa: E402
from ..sources.letor import parse_letor_lines, parse_sparse_letor_lines  # noqa: E402

# Label of a line item by return flag, and the linear scorer's weights.
RETURN_LABEL = {"R": 2, "A": 1}
LINEAR_WEIGHTS = [0.02, 0.00001, -1.0, 1.0]


def _label(c):
    expr = F.lit(0)
    for flag, v in RETURN_LABEL.items():
        expr = F.when(c == flag, F.lit(v)).otherwise(expr)
    return expr


def letor_lines(spark, sf):
    """LETOR text lines built from lineitem: group = order, label from the return flag."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_linenumber").alias("row_id"),
        F.format_string("%d qid:%d 1:%s 2:%s 3:%s 4:%s # li%d", _label(F.col("l_returnflag")), "l_orderkey",
                        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber").alias("value"),
    )


def sparse_letor_lines(spark, sf):
    """Sparse lines: zero features omitted, index 1 repeated (a leading 1:0, last one wins)."""
    li = table(spark, sf, "lineitem")
    vals = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [F.when(F.col(v) != 0, F.concat(F.lit(f"{i}:"), F.col(v).cast("string"))) for i, v in enumerate(vals, start=1)]
    return li.select(
        F.col("l_linenumber").alias("row_id"),
        F.concat_ws(" ", _label(F.col("l_returnflag")).cast("string"), F.lit("1:0"), *pairs, F.concat(F.lit("# "), F.col("l_orderkey").cast("string"))).alias("value"),
    )


def _letor(spark, sf):
    return parse_letor_lines(letor_lines(spark, sf))


def letor_parse(spark, sf):
    """Dense LETOR lines parsed back (label, group, positional features)."""
    return rounded(_letor(spark, sf).withColumn("features", F.transform("features", lambda x: x.cast("double"))))


def letor_sparse_parse(spark, sf):
    """Sparse LETOR lines (1-based indices, absent = 0, last repeat wins), 6 features."""
    p = parse_sparse_letor_lines(sparse_letor_lines(spark, sf), num_features=6)
    return rounded(p.withColumn("features", F.transform("features", lambda x: x.cast("double"))))


def ltr_fold_overview(spark, sf):
    """A12 + S7: 5 query-level folds (md5-seeded parts), counts per fold and split and in full."""
    return LT.fold_overview(LT.fold_parts(_letor(spark, sf), "group_id", 5, 42))


def ltr_describe(spark, sf):
    """Description of the sparse split."""
    p = parse_sparse_letor_lines(sparse_letor_lines(spark, sf), num_features=6)
    return rounded(LT.describe_split(p))


def ltr_linear_eval(spark, sf):
    """E9 + L13 + P7: Precision@10, MAP@10, NDCG@10 of a fixed linear scorer over all groups."""
    s = LT.linear_scores(_letor(spark, sf), LINEAR_WEIGHTS).withColumn("score", F.round("score", DIGITS))
    return rounded(LT.ltr_metrics(s, k=10))


def ltr_gbt_eval(spark, sf):
    """L8 + L9 + L12 + L14 + E10 + A14: boosted trees (RMSE, QueryRMSE) per fold, test metrics,
    mean per loss (rows only: a model fit)."""
    parted = LT.fold_parts(_letor(spark, sf), "group_id", 5, 42).checkpoint(eager=True)
    rows = None
    for fold, part_split in ((f, {p: s for ff, p, s in LT.fold_split_map(5) if ff == f}) for f in range(1, 6)):
        m = F.create_map(*[x for p, s in part_split.items() for x in (F.lit(p), F.lit(s))])
        df = parted.withColumn("split", m[F.col("part")])
        for loss in ("RMSE", "QueryRMSE"):
            model = LT.train_gbt(df.filter("split = 'train'"), loss, max_depth=4, max_iter=10, vali=df.filter("split = 'vali'"))
            pred = LT.apply_model(model, df.filter("split = 'test'"))
            mt = LT.ltr_metrics(pred.withColumn("score", F.round("score", DIGITS)), k=10)
            mt = mt.withColumn("loss", F.lit(loss)).withColumn("fold", F.lit(fold))
            rows = mt if rows is None else rows.unionByName(mt)
    summary = rows.groupBy("loss").agg(*[F.avg(c).alias(c) for c in ("Precision@10", "MAP@10", "NDCG@10")])
    return rounded(summary)


def ltr_pair_weights(spark, sf):
    """Per group the number of preference pairs and the sum of their nDCG@10 changes under the linear scorer."""
    scored = LT.linear_scores(_letor(spark, sf), LINEAR_WEIGHTS).withColumn("score", F.round("score", DIGITS))
    return rounded(LT.pair_weights(scored, 10))


def ltr_pairwise_eval(spark, sf):
    """L10 + L11 + L14 + E10 + A14: both pairwise losses on every fold, test metrics per (loss, fold) and their means
    (fold 0), the best loss first (rows only: a model fit)."""
    parted = LT.fold_parts(_letor(spark, sf), "group_id", 5, 42).checkpoint(eager=True)
    names = ["Precision@10", "MAP@10", "NDCG@10"]
    lists = LT.fit_lists(parted, keep=["part"]).checkpoint()  # cut once for the fits of all folds
    weights = {}
    for fold in range(1, 6):
        part = {s: [p for f, p, split in LT.fold_split_map(5) if f == fold and split == s] for s in ("train", "test")}
        train, start = lists.filter(F.col("part").isin(part["train"])), None
        for loss in ("PairLogit", "YetiRank"):
            start = LT.train_pairwise(train, loss, start=start, listed=True)
            weights[loss, fold, part["test"][0]] = start
    rows = LT.fold_metrics(parted, weights, score_digits=DIGITS).select("loss", "fold", *names).checkpoint()
    summary = rows.groupBy("loss").agg(*[F.avg(c).alias(c) for c in names]).select("loss", F.lit(0).alias("fold"), *names)
    mean = F.max(F.when(F.col("fold") == 0, F.col("NDCG@10"))).over(Window.partitionBy("loss"))
    return rounded(rows.unionByName(summary)).withColumn("_mean", mean).orderBy(F.desc("_mean"), "loss", "fold").drop("_mean")


from ..sources.testdata import table  # noqa: E402

QUERIES.update({
    "ltr_pair_weights": ltr_pair_weights,
    "ltr_pairwise_eval": ltr_pairwise_eval,
    "letor_parse": letor_parse,
    "letor_sparse_parse": letor_sparse_parse,
    "ltr_fold_overview": ltr_fold_overview,
    "ltr_describe": ltr_describe,
    "ltr_linear_eval": ltr_linear_eval,
    "ltr_gbt_eval": ltr_gbt_eval,
})


# ------------------------------------------------------------------ pooled collections, grouped split
from ..operators import pools as PL  # noqa: E402

# Pools are stored in rows of at most so many documents; the pools of the pool queries begin with so many that a search finds.
POOL_ROWS = 64
POOL_FOUND = 20


def pooled_examples(spark, sf, layout: str = "array", found: int = 0, judged=None):
    """Pooled examples from the tables: with n queries, the pool of query q is every document whose id is q modulo n (title = document source, chunk =
    text, support = derived relevance), so the pools hold the whole collection. With ``found``, the query's first so many documents by BM25 over the
    whole collection stand before them, in rank order, and are not listed twice. A pool is stored in rows of
    ``POOL_ROWS`` documents (``part`` counts them). ``judged``: the derived judgements, where the caller has them."""
    docs, queries = _io(spark, sf)
    n = queries.count()
    raw = table(spark, sf, "documents").filter("doc_id is not null")
    at = F.call_function("div", F.col("doc_id"), F.lit(n).cast("long")) + found
    named = [F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", F.col("source").alias("dsrc")]
    d = raw.select(*named, F.pmod("doc_id", F.lit(n)).cast("string").alias("query_id"), at.alias("at"))
    if found:
        run = bm25_search(docs, queries, top_k=found, run_name="pool", score_digits=DIGITS).checkpoint()  # ``found`` rows a query
        best = raw.select(*named).join(run.select("query_id", "doc_id", (F.col("rank") - 1).cast("long").alias("at")), "doc_id")
        d = best.unionByName(d.join(run, ["query_id", "doc_id"], "left_anti"))
    d = d.withColumn("part", F.call_function("div", F.col("at"), F.lit(POOL_ROWS).cast("long")).cast("int"))
    e = d.join(derive_qrels(docs, queries) if judged is None else judged, ["query_id", "doc_id"], "left")
    entry = F.struct("at", F.col("dsrc").alias("doc_name"), F.col("text").alias("doc_chunk"),
                     F.coalesce("relevance", F.lit(0)).alias("support"), "lang")
    g = e.groupBy("query_id", "part").agg(F.array_sort(F.collect_list(entry)).alias("_p"))  # at most POOL_ROWS a group
    pool = F.transform("_p", lambda x: F.struct(x["doc_name"].alias("doc_name"), x["doc_chunk"].alias("doc_chunk"), x["support"].alias("support")))
    if layout == "struct":
        def field(name):
            return lambda x: x[name]
        pool = F.struct(*[F.transform("_p", field(n)).alias(n) for n in ("doc_name", "doc_chunk", "support")])
    out = g.join(queries.withColumnRenamed("text", "query"), "query_id").select(
        "query_id", "query", "part",
        F.col("_p")[0]["lang"].alias("source"),
        F.col("_p")[0]["doc_name"].alias("doc_url"),
        F.struct(F.lit(None).cast("string").alias("mapped_id")).alias("oracle"),
        pool.alias("doc_pool"),
    )
    # the pooled dataset is an input table in its own right: materialise it once
    return out.withColumn("ex_ord", F.col("query_id").cast("long")).checkpoint(eager=True)


IN_PARTS = {"part_col": "part", "part_rows": POOL_ROWS}


def pool_collection_docs(spark, sf):
    """C1-C4 + A19: documents of the pooled collection (first occurrence wins)."""
    return PL.build_collection(pooled_examples(spark, sf, found=POOL_FOUND), "ex_ord", **IN_PARTS)[0]


def pool_collection_qrels(spark, sf):
    """C4 + U2: qrels of the pooled collection (struct-of-arrays layout, distinct rows)."""
    return PL.build_collection(pooled_examples(spark, sf, "struct", found=POOL_FOUND), "ex_ord", **IN_PARTS)[2]


def pool_bm25(spark, sf):
    """BM25 inside each query's own pool (per-pool statistics), all pools in one job."""
    return PL.pooled_bm25(pooled_examples(spark, sf, found=POOL_FOUND), top_k=100, score_digits=DIGITS, **IN_PARTS)


def _grouped(spark, sf):
    px = pooled_examples(spark, sf, found=POOL_FOUND).filter("part = 0")  # one row per example
    px = px.withColumn("group_key", PL.group_key(px))
    return SP.grouped_split(px.select("query_id", "group_key", "source"), "group_key", "source", 0.1, 42)


def grouped_split(spark, sf):
    """Grouped, source-stratified split of the pooled examples."""
    return _grouped(spark, sf).select("query_id", "group_key", "source", "split")


def split_metadata(spark, sf):
    """Split metadata record."""
    return SP.split_metadata(_grouped(spark, sf), "benchmark-pools", 0.1, 42)


QUERIES.update({
    "pool_collection_docs": pool_collection_docs,
    "pool_collection_qrels": pool_collection_qrels,
    "pool_bm25": pool_bm25,
    "grouped_split": grouped_split,
    "split_metadata": split_metadata,
})


# ------------------------------------------------------------------ run text round trip, ranking helpers
from ..sources.files import parse_trec_lines, trec_lines  # noqa: E402
from ..operators.ranking import group_ordinals, normalize_minmax_by_query  # noqa: E402


def trec_roundtrip(spark, sf):
    """S10 + S4: the BM25 top-10 run formatted as TREC lines and parsed back (rank offset 0)."""
    return parse_trec_lines(trec_lines(bm25_top10(spark, sf)), rank_offset=0)


def run_minmax(spark, sf):
    """Min-max normalised BM25 scores of the top-20 run."""
    docs, queries = _io(spark, sf)
    run = bm25_search(docs, queries, top_k=20, run_name="bm25", score_digits=DIGITS)
    return rounded(normalize_minmax_by_query(run, "score", "score_minmax").select("query_id", "doc_id", "score", "score_minmax"))


def run_top3_rows(spark, sf):
    """W2 + W3: first 3 rows per query by rank of the top-20 run (k as a cut of rows)."""
    docs, queries = _io(spark, sf)
    run = bm25_search(docs, queries, top_k=20, run_name="bm25", score_digits=DIGITS)
    return top_k_per_query(run, 3)


def query_ordinals(spark, sf):
    """W5 + P1: dense 0-based codes of the sorted (string) query ids."""
    return group_ordinals(load_queries(spark, sf).select("query_id"), "query_id", "group_id")


def preview_sample(spark, sf):
    """A seeded sample of 5 queries (md5 order) - a sampling operator, limit by design."""
    from ..functions.text import seeded_key
    return load_queries(spark, sf).orderBy(seeded_key(42, F.col("query_id")), "query_id").limit(5).select("query_id")


QUERIES.update({
    "trec_roundtrip": trec_roundtrip,
    "run_minmax": run_minmax,
    "run_top3_rows": run_top3_rows,
    "query_ordinals": query_ordinals,
    "preview_sample": preview_sample,
})


# ------------------------------------------------------------------ normalisation and variants
from ..operators import normalize as NZ  # noqa: E402


def _vocab(spark, sf):
    docs, queries = _io(spark, sf)
    return NZ.vocabulary_words(docs.select("text"), queries.select("text"))


def stem_vocab(spark, sf):
    """Porter (1980) stem of every distinct word of documents and queries."""
    return NZ.stem_mapping(_vocab(spark, sf))


def lemma_vocab(spark, sf):
    """N3 (re-aimed): rule-derived lemma dictionary over the vocabulary."""
    return NZ.lemma_mapping(_vocab(spark, sf))


def subword_vocab(spark, sf):
    """N4 (re-aimed): subword pieces of every distinct word, by a vocabulary of the substrings that are frequent in the queries' words."""
    return NZ.subword_mapping(_vocab(spark, sf), NZ.frequent_pieces(NZ.vocabulary_words(_io(spark, sf)[1])).checkpoint())


def query_versions(spark, sf):
    """Original / stemmed / lemmatized versions of every query."""
    docs, queries = _io(spark, sf)
    return NZ.text_variants(docs, queries)[1]


def variant_stats(spark, sf):
    """N6 + N2 + N3: collection statistics of each document variant."""
    docs, queries = _io(spark, sf)
    dv, _ = NZ.text_variants(docs, queries)
    return rounded(ST.collection_stats(dv, group_cols=["variant"]))


def run_all_models(spark, sf):
    """R4 + E8: BM25 and TF-IDF over the three variants (one job per model), evaluated per run."""
    docs, queries = _io(spark, sf)
    dv, qv = NZ.text_variants(docs, queries)
    # processed collections are written once (as the reference keeps them as files)
    dv, qv = dv.checkpoint(eager=True), qv.checkpoint(eager=True)
    runs = NZ.run_all_models(dv, qv, top_k=RUN_K, score_digits=DIGITS)
    return rounded(evaluate_runs(runs, derive_qrels(docs, queries), RUN_MEASURES, digits=4))


QUERIES.update({
    "stem_vocab": stem_vocab,
    "lemma_vocab": lemma_vocab,
    "subword_vocab": subword_vocab,
    "query_versions": query_versions,
    "variant_stats": variant_stats,
    "run_all_models": run_all_models,
})


# ------------------------------------------------------------------ final comparison report
def _report_rows(both, queries_of):
    """BM25, re-ranked (k = 20), dense and mixture rows of both datasets on the test queries."""
    test, qrels = both["scored"].filter("split = 'vali'"), both["qrels"].filter("split = 'vali'")
    alpha, mix_run = _tuned_mixture(both)
    first = top_k_per_query(test, 20)
    ce = DN.score_pairs_cross(first, both["queries"], both["docs"]).withColumn("rerank_score", F.round("rerank_score", DIGITS))
    ce_run = make_ranked_run(ce, "rerank_score", "ce", 20, partition_cols=["dataset"])
    dv = DN.hashed_embeddings(both["docs"], "doc_id", "text", EMBED_DIM).withColumnRenamed("id", "doc_id").withColumn("dataset", F.substring_index("doc_id", ":", 1))
    qv = DN.hashed_embeddings(queries_of, "query_id", "text", EMBED_DIM).withColumnRenamed("id", "query_id").withColumn("dataset", F.substring_index("query_id", ":", 1))
    dense = DN.dense_search(dv, qv, top_k=20, run_name="dense", score_digits=DIGITS, group_col="dataset")
    return _method_rows([("BM25", first), ("CE k=20", ce_run), ("Dense hash64", dense), (f"Mixture a={alpha:.2f}", mix_run)], qrels)


def final_report(spark, sf):
    """E11 + U1: BM25, re-ranker, dense search and mixture side by side on the test queries of both collections, sorted."""
    both = scored_datasets(spark, sf)
    rows = _report_rows(both, both["queries"].filter("split = 'vali'"))
    return rounded(rows).orderBy("dataset", "method")


QUERIES["final_report"] = final_report


# ------------------------------------------------------------------ ranking-loss trees
import hashlib  # noqa: E402

from ..operators import rank_lockstep as RL  # noqa: E402
from ..operators import rank_trees as RT  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402

# The small ensemble of the staged evaluation, as (feature, threshold, step at or below it, step above it).
STUMPS = [(0, 25.5, -0.5, 0.5), (2, 0.055, 0.25, -0.125), (1, 40000.5, 0.375, -0.25), (3, 0.035, -0.75, 0.625), (0, 10.5, 1.5, -0.0625)]


def stump_ensemble() -> RT.Ensemble:
    import numpy as np

    one = lambda f, t, low, high: RT.Tree(np.array([f, -1, -1]), np.array([t, 0.0, 0.0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0.0, low, high]))
    return RT.Ensemble([one(*x) for x in STUMPS])


def ltr_ndcg_gradients(spark, sf):
    """Push and curvature of every LETOR row under the nDCG@10-weighted pairwise loss at the linear scorer's scores."""
    scored = LT.linear_scores(_letor(spark, sf), LINEAR_WEIGHTS)
    rows = scored.select(
        F.col("group_id").alias("g"), F.struct("row_id", F.col("label").cast("double").alias("label"), "features").alias("r"),
        F.col("label").cast("double").alias("y"), F.round("score", DIGITS).alias("s"),
    ).distinct().checkpoint()  # parsed once, read by the heads, the ideal lists and the pairs
    found = RT.ndcg_gradients(rows.join(RT.ideal_gains(rows, 10), "g", "left"), 10)
    return rounded(found.select(F.col("g").alias("group_id"), "r.row_id", "r.label", "push", "curve"))


def ltr_staged_eval(spark, sf):
    """L12 + E9: the three metrics for every prefix of a fixed ensemble, in one evaluation grouped by the number of trees."""
    rows = _letor(spark, sf)
    return rounded(RT.staged_metrics(rows, stump_ensemble(), score_digits=DIGITS))


def ltr_saved_models(spark, sf):
    """L14 + S14 + E10 + A14 + L8-L12: boosted trees of four losses on five folds, grown together and stored by (loss, fold); metrics of
    the stored models per (loss, fold) and their means (fold 0), the best loss first (rows only: model fits). A later run on the
    same rows loads the models."""
    rows = _letor(spark, sf).checkpoint()  # parsed once, read by the fingerprint, the parts and the fits
    seen = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    version = hashlib.md5(f"{sf}:{seen[0]}:{seen[1]}:depth6:rounds30:together".encode()).hexdigest()
    store = RT.ModelStore(spark, f"{ensure_checkpoint_dir(spark)}/rankers-{version}")
    parted = LT.fold_parts(rows, "group_id", 5, 42).checkpoint(eager=True)
    part = {f: {s: [p for ff, p, split in LT.fold_split_map(5) if ff == f and split == s] for s in ("train", "vali", "test")} for f in range(1, 6)}
    side = lambda f, s: parted.filter(F.col("part").isin(part[f][s]))
    train, vali = ({f: part[f][s] for f in part} for s in ("train", "vali"))

    def fit(keys):
        return RL.fit_rankers(parted, keys, train, vali, depth=6, rounds=30, patience=5, block=5)

    models = RT.fit_together(store, [(loss, fold) for fold in range(1, 6) for loss in RT.LOSSES], fit, at_once=8)
    found = RT.evaluate_models(models, lambda f: side(f, "test"), score_digits=DIGITS).checkpoint()
    names = ["Precision@10", "MAP@10", "NDCG@10"]
    means = RT.mean_over_folds(found).select("loss", F.lit(0).alias("fold"), *names)
    best = F.max(F.when(F.col("fold") == 0, F.col("NDCG@10"))).over(Window.partitionBy("loss"))
    return rounded(found.select("loss", "fold", *names).unionByName(means)).withColumn("_best", best).orderBy(F.desc("_best"), "loss", "fold").drop("_best")


def _fit_end_to_end(train, rounds=200, patience=20):
    """The ranker of the end-to-end job: nDCG-weighted trees of depth 6 on nine of ten training queries, the best prefix by the tenth."""
    parts = SP.query_split(train.select("query_id").distinct(), "query_id", 0.1, 43).select("query_id", F.col("split").alias("part"))
    both = train.join(parts, "query_id").checkpoint()
    fit, held = both.filter("part = 'train'"), both.filter("part = 'vali'")
    return RT.fit_ranker(fit, "YetiRank", depth=6, rounds=rounds, vali=held, patience=patience, k=20)


def _tree_ltr_rows(both):
    """Features of every candidate, trees fitted on the training queries of ``documents``, applied to the test queries of both."""
    feats = FE.extract_lexical_features(both["scored"].drop("run_name", "Q0"), both["docs"], both["queries"])
    frame = FE.ltr_frame(feats, both["qrels"].drop("split", "dataset")).checkpoint(eager=True)
    where = both["queries"].select("query_id", "dataset", "split")
    frame = frame.drop("dataset", "split").join(where, "query_id").withColumnRenamed("relevance", "label")
    model = _fit_end_to_end(frame.filter("dataset = 'documents' and split = 'train'").drop("split"))
    pred = frame.filter("split = 'vali'").withColumn("score", F.round(model.score(F.col("features")), DIGITS))
    run = make_ranked_run(pred, "score", "tree_ltr", 20, partition_cols=["dataset"])
    return _method_rows([("Tree LTR", run)], both["qrels"].filter("split = 'vali'"))


def ltr_end_to_end(spark, sf):
    """L15 + L11-L13 + L7 + E8: BM25 candidates -> dense score -> lexical features -> trees of the ranking loss fit on the training
    queries of ``documents`` -> applied to the test queries of both collections -> top 20 -> metrics (rows only: includes a model fit)."""
    return rounded(_tree_ltr_rows(scored_datasets(spark, sf))).orderBy("dataset", "method")


def final_report_all(spark, sf):
    """The rows of ``final_report`` and of ``ltr_end_to_end`` in one table (rows only: includes a model fit)."""
    both = scored_datasets(spark, sf)
    rows = _report_rows(both, both["queries"].filter("split = 'vali'")).unionByName(_tree_ltr_rows(both))
    return rounded(rows).orderBy("dataset", "method")


QUERIES.update({
    "ltr_ndcg_gradients": ltr_ndcg_gradients,
    "ltr_staged_eval": ltr_staged_eval,
    "ltr_saved_models": ltr_saved_models,
    "ltr_end_to_end": ltr_end_to_end,
    "final_report_all": final_report_all,
})
