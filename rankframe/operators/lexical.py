"""Lexical retrieval: tokenised collections, document frequencies, BM25 and TF-IDF search.

Plan shape (shared collection):

* document frequencies come from ``explode(array_distinct(tokens))`` with a map-side partial
  count, so the shuffle carries one row per (partition, term) instead of one per token;
* term frequencies are built only for query terms: exploded tokens are semi-joined against the
  distinct query terms before counting (size-checked broadcast, AQE skew join beyond it);
* postings meet once, on the document; counts and score sums run on that partitioning, and only
  map-side top-k rows (``WindowGroupLimit``) are shuffled again.

A *collection key* (``collection_cols``) scores many collections in one job: a text variant, a
parameter set, or one pool per query (R3). With no key a constant key is used, so the join of
per-collection statistics is an equi-join with a one-row side, never a cross join.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_tokens, term_counts, tokenize
from ..plans.broadcast import checked_broadcast, within_bound
from ..plans.ordinals import global_ordinal
from .block_scores import QUERY_ROWS, QuerySide, block_scores, fits
from .ranking import make_ranked_run

Tokenizer = Callable[[Column], Column]
_ROW = "_rf_row"

# (query, document) pairs, times the cells of a grid, that one task may sum and sort: some 450 bytes each
PAIRS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def _qkeys(keys: Sequence[str]) -> list[str]:
    return list(keys) + ([] if "query_id" in keys else ["query_id"])


def tokenized_docs(
    docs: DataFrame,
    collection_cols: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """(keys, doc_id, _rf_row, tokens, dl). ``row_col`` separates repeated ids inside a collection."""
    # 0, but no literal: a folded constant among the grouping keys would hide the partitioning on the document
    row = (F.col(row_col) if row_col else F.coalesce(F.length(F.col("doc_id").cast("string")) * 0, F.lit(0))).cast("long")
    return docs.select(
        *collection_cols,
        F.col("doc_id").cast("string").alias("doc_id"),
        row.alias(_ROW),
        tokenizer(F.col(text_col)).alias("tokens"),
    ).withColumn("dl", F.size("tokens"))


def query_terms(
    queries: DataFrame,
    collection_cols: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
    text_col: str = "text",
) -> DataFrame:
    """(keys, query_id, term, qtf): repeated query terms count repeatedly."""
    qk = _qkeys(collection_cols)
    q = queries.withColumn("query_id", F.col("query_id").cast("string"))
    return (
        q.select(*qk, explode_tokens(tokenizer(F.col(text_col))).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy(*qk, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def vocabulary(tok_docs: DataFrame, collection_cols: Sequence[str] = ()) -> DataFrame:
    """One pass over the collection: (keys, term, df, tot).

    Each document contributes its distinct terms (df) and one extra row with a null term that
    carries its length, so the null-term row of a collection holds ``df = n_docs`` and
    ``tot = total tokens``. The partial aggregation runs map-side; the shuffle carries one row
    per (partition, term).
    """
    terms = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    return (
        tok_docs.select(*collection_cols, "dl", F.explode_outer(terms).alias("term"))
        .groupBy(*collection_cols, "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl").cast("long"))).alias("tot"))
    )


@dataclass
class LexicalIndex:
    """Per-term statistics of one or many collections.

    ``terms``: (keys, term, df) and, for BM25, ``idf``; ``stats``: (keys, n_docs, avgdl) as a
    DataFrame when there are collection keys, else ``None`` and the scalars ``n_docs``/``avgdl``.
    """

    keys: list[str]
    terms: DataFrame
    stats: DataFrame | None
    n_docs: float | None = None
    avgdl: float | None = None

    def with_stats(self, df: DataFrame) -> DataFrame:
        if self.keys:
            return df.join(self.stats, self.keys)
        return df.withColumn("n_docs", F.lit(self.n_docs)).withColumn("avgdl", F.lit(self.avgdl))


def build_index(tok_docs: DataFrame, collection_cols: Sequence[str] = ()) -> LexicalIndex:
    """Vocabulary plus collection statistics.

    The vocabulary is checkpointed to the shared checkpoint folder (it is read again for the
    statistics and the idf of query terms). With no collection key the two scalars are read from
    its null-term row; with keys the statistics are joined on the keys.
    """
    keys = list(collection_cols)
    vocab = vocabulary(tok_docs, keys)
    if keys:
        # read by the statistics, the idf and the mean-idf check: materialise once
        vocab = vocab.checkpoint(eager=True)
        stats = vocab.filter(F.col("term").isNull()).select(
            *keys, F.col("df").alias("n_docs"), (F.col("tot") / F.col("df")).alias("avgdl")
        )
        return LexicalIndex(keys, vocab.filter(F.col("term").isNotNull()).select(*keys, "term", "df"), stats)
    vocab = vocab.checkpoint(eager=True)
    row = vocab.filter(F.col("term").isNull()).select("df", "tot").first()
    n_docs, tot = (row["df"], row["tot"]) if row else (0, 0)
    avgdl = (tot / n_docs) if n_docs else 0.0
    return LexicalIndex(keys, vocab.filter(F.col("term").isNotNull()).select("term", "df"), None, float(n_docs), float(avgdl))


def bm25_idf(index: LexicalIndex, epsilon: float = 0.25) -> tuple[DataFrame, float | None]:
    """(keys, term, idf, avgdl) with the epsilon floor.

    raw = ln(n - df + .5) - ln(df + .5); a negative raw idf becomes epsilon times the mean raw
    idf over the whole vocabulary of the collection (negative entries included).
    """
    keys = index.keys
    raw = index.with_stats(index.terms).withColumn(
        "raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    m = None
    if keys:
        mean = raw.groupBy(*keys).agg(F.avg("raw_idf").alias("mean_raw_idf"))
        raw = raw.join(mean, keys)
        # smallest mean over collections (one small job): tells whether any score can be < 0
        lo = mean.agg(F.min("mean_raw_idf")).first()[0]
        m = float(lo) if lo is not None else 0.0
    else:
        m = raw.agg(F.avg("raw_idf")).first()[0]
        m = float(m) if m is not None else 0.0
        raw = raw.withColumn("mean_raw_idf", F.lit(m))
    out = raw.select(
        *keys, "term", "avgdl",
        F.when(F.col("raw_idf") < 0, F.lit(epsilon) * F.col("mean_raw_idf")).otherwise(F.col("raw_idf")).alias("idf"),
    )
    return out, m


def pair_tasks(index: LexicalIndex, qterms: DataFrame, cells: int = 1) -> int:
    """Tasks over which the (query, document) pairs of a search are dealt, so that none holds more than ``PAIRS_PER_TASK``.
    Counted as if every query matched every document of its collection."""
    asked = qterms.select(*_qkeys(index.keys)).distinct()
    if index.keys:
        n = asked.join(index.stats, index.keys).agg(F.sum("n_docs")).first()[0] or 0
    else:
        n = asked.count() * index.n_docs
    return max(1, math.ceil(n * cells / PAIRS_PER_TASK))


def matched_postings(tok_docs: DataFrame, qterms: DataFrame, collection_cols: Sequence[str] = (),
                     small: bool | None = None, tasks: int = 1) -> DataFrame:
    """(keys, doc_id, _rf_row, term, tf, dl) for query terms only. ``small``: the caller has
    already proven the query-term table within the broadcast bound. ``tasks`` over 1: the postings are dealt
    by document over at least so many tasks (``pair_tasks``)."""
    keys = list(collection_cols)
    terms = qterms.select(*keys, "term").distinct()
    wanted = F.broadcast(terms) if small else (terms if small is False else checked_broadcast(terms))
    if tasks > 1:
        # postings are few bytes and the pairs made of them many, so the number of tasks is set here by the pairs: left to the
        # postings' bytes, a few tasks would sum all of them. A row counts its own terms; repeated ids meet in the sum
        own = tok_docs.select(*keys, "doc_id", _ROW, "dl", F.explode_outer(term_counts("tokens")).alias("_p"))
        own = own.select(*keys, "doc_id", _ROW, "dl", F.col("_p.term").alias("term"), F.col("_p.tf").alias("tf"))
        dealt = own.join(wanted, keys + ["term"], "left_semi").repartition(max(tasks, tok_docs.sparkSession.sparkContext.defaultParallelism), *keys, "doc_id")
        return dealt.groupBy(*keys, "doc_id", _ROW, "term").agg(F.first("dl").alias("dl"), F.sum("tf").alias("tf"))
    occ = tok_docs.select(*keys, "doc_id", _ROW, "dl", explode_tokens("tokens").alias("term"))
    # grouped by document first (a list no longer than the document): this is the only exchange of
    # postings, none when the collection is clustered by doc_id; the counts here and the score
    # sums of the callers run on the same partitioning
    doc = [*keys, "doc_id", _ROW]
    per_doc = (
        occ.join(wanted, keys + ["term"], "left_semi")
        .groupBy(*doc)
        .agg(F.collect_list("term").alias("_rf_terms"), F.first("dl").alias("dl"))
    )
    return (
        per_doc.select(*doc, "dl", F.explode("_rf_terms").alias("term"))
        .groupBy(*doc, "term", "dl")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _scored_pairs(tok_docs, queries, collection_cols, tokenizer, epsilon, index=None, cells=1):
    """Query terms joined to their postings, with idf and avgdl attached; also the mean raw
    idf (shared collection only, else ``None``). ``cells``: rows that the caller makes of each (query, document) pair."""
    keys = list(collection_cols)
    qt = query_terms(queries, keys, tokenizer)
    index = index or build_index(tok_docs, keys)
    idf, mean = bm25_idf(index, epsilon)
    qt_idf = qt.join(idf, keys + ["term"])  # idf is unique per (keys, term): at most |qt| rows
    # one count bounds both broadcast sides (distinct terms and qt_idf are no larger than qt)
    small = within_bound(qt)
    post = matched_postings(tok_docs, qt, keys, small=small, tasks=pair_tasks(index, qt, cells))
    return post.join(F.broadcast(qt_idf) if small else qt_idf, keys + ["term"]), mean


def first_documents(tok_docs: DataFrame, k: int) -> list[tuple[str, int]]:
    """The k smallest (doc_id, row) of a shared collection (a bounded top-k, read once)."""
    rows = tok_docs.select("doc_id", _ROW).orderBy("doc_id", _ROW).limit(k).collect()
    return [(r["doc_id"], r[_ROW]) for r in rows]


def zero_candidates_keyed(tok_docs: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, query_id, doc_id, _rf_row): the first k documents of each collection (doc_id
    order, a map-side top-k per key) for each query of that collection - an equi-join on the
    collection key, at most k rows per query."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy("doc_id", _ROW)
    firstk = tok_docs.select(*keys, "doc_id", _ROW).withColumn("_rf_n", F.row_number().over(w)).filter(F.col("_rf_n") <= k).drop("_rf_n")
    qk = _qkeys(keys)
    q = queries.withColumn("query_id", F.col("query_id").cast("string")).select(*qk).distinct()
    return q.join(firstk, keys)


def zero_candidates(queries: DataFrame, first_docs: list[tuple[str, int]]) -> DataFrame | None:
    """(query_id, doc_id, _rf_row) for every query and each of the given documents.

    The document list is a bounded literal, expanded per query by a generator (no join).
    """
    if not first_docs:
        return None
    arr = F.array(*[F.struct(F.lit(d).alias("doc_id"), F.lit(r).cast("long").alias(_ROW)) for d, r in first_docs])
    return queries.select(F.col("query_id").cast("string").alias("query_id")).distinct().select("query_id", F.inline(arr))


def bm25_contribution(k1: Column | float, b: Column | float) -> Column:
    k1c = k1 if isinstance(k1, Column) else F.lit(k1)
    bc = b if isinstance(b, Column) else F.lit(b)
    tf, dl, avgdl = F.col("tf"), F.col("dl"), F.col("avgdl")
    return F.col("qtf") * F.col("idf") * (tf * (k1c + 1)) / (tf + k1c * (1 - bc + bc * dl / avgdl))


def bm25_scores(
    docs: DataFrame,
    queries: DataFrame,
    params: BM25Params = BM25Params(),
    collection_cols: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
    doc_row_col: str | None = None,
    tok_docs: DataFrame | None = None,
    top_k: int | None = None,
    score_digits: int | None = None,
) -> tuple[DataFrame, bool]:
    """(keys, query_id, doc_id, _rf_row, score) for documents sharing a query term, and whether
    scores cannot be negative (mean raw idf >= 0).

    The sums run on the partitioning of the postings, so no (query, doc) rows are shuffled. With ``top_k`` (scores to be
    ranked by ``score_digits`` digits) each task adds up its documents in arrays (``block_scores``) and, where no score is negative, leaves out rows that cannot be
    among a query's first; not so with a query side too large for every task or with repeated document ids, whose counts must meet.
    """
    keys = list(collection_cols)
    td = tok_docs if tok_docs is not None else tokenized_docs(docs, collection_cols, tokenizer, row_col=doc_row_col)
    if top_k and fits(td, keys):
        qt = query_terms(queries, keys, tokenizer)
        if within_bound(qt, QUERY_ROWS) and _unique_ids(td, keys):
            index = build_index(td, keys)
            idf, mean = bm25_idf(index, params.epsilon)
            nonnegative = mean is not None and mean >= 0
            rows = qt.join(idf, keys + ["term"]).select(*_side_key(keys), "query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl").collect()
            side = QuerySide([tuple(r)[:4] for r in rows], {r[0]: r["avgdl"] for r in rows})
            listed = td.select(*keys, "doc_id", _ROW, F.col("tokens").alias("terms"), F.col("dl").alias("norm"))
            return block_scores(listed, side, keys, _ROW, (params.k1, params.b), top_k if nonnegative else None, _margin(score_digits)), nonnegative
    pairs, mean = _scored_pairs(td, queries, collection_cols, tokenizer, params.epsilon)
    qk = _qkeys(keys)
    contrib = pairs.select(*qk, "doc_id", _ROW, bm25_contribution(params.k1, params.b).alias("c"))
    return contrib.groupBy(*qk, "doc_id", _ROW).agg(F.sum("c").alias("score")), mean is not None and mean >= 0


def _side_key(keys: Sequence[str]) -> list[Column]:
    return [F.col(keys[0]).alias("key") if keys else F.lit("").alias("key")]


def _margin(digits: int | None) -> float:
    """Scores further apart keep their order when they are rounded."""
    return 0.0 if digits is None else 10.0 ** (-digits)


def _unique_ids(tok_docs: DataFrame, keys: Sequence[str]) -> bool:
    """No (document, row) is listed twice in a collection; reads the ids only."""
    return tok_docs.groupBy(*keys, "doc_id", _ROW).count().filter("count > 1").isEmpty()


def _grid_structs(part_cols: Sequence[str], parts: Sequence[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(part_cols, row)]) for row in parts])


def fill_first_documents(
    scores: DataFrame,
    tok_docs: DataFrame,
    queries: DataFrame,
    top_k: int,
    collection_cols: Sequence[str] = (),
    part_cols: Sequence[str] = (),
    parts: Sequence[tuple] | None = None,
) -> DataFrame:
    """The ``top_k`` best rows of every query, unmatched documents (score 0) among them, for
    scores that cannot be negative.

    The zero rows of a top k lie among the first k documents in doc_id order. The matched rows
    are cut to k per query first (map-side), so only 2k rows a query meet the zero rows; a matched
    document below that cut cannot come back, as k rows rank before it. Pass scores rounded as
    they will be ranked.
    """
    from pyspark.sql import Window

    keys = list(collection_cols)
    row = [*part_cols, *_qkeys(keys), "doc_id", _ROW]
    w = Window.partitionBy(*part_cols, *_qkeys(keys)).orderBy(F.desc("score"), "doc_id", _ROW)
    best = scores.select(*row, "score", F.row_number().over(w).alias("_rf_n")).filter(F.col("_rf_n") <= top_k).drop("_rf_n")
    cands = zero_candidates_keyed(tok_docs, queries, keys, top_k) if keys else zero_candidates(queries, first_documents(tok_docs, top_k))
    if cands is None:
        return best
    if parts is not None:
        cands = cands.select("*", F.inline(_grid_structs(part_cols, parts)))
    zeros = cands.select(*row, F.lit(0.0).alias("score"))
    return best.unionByName(zeros).groupBy(*row).agg(F.max("score").alias("score"))


def fill_zero_scores(
    scores: DataFrame,
    tok_docs: DataFrame,
    queries: DataFrame,
    top_k: int,
    collection_cols: Sequence[str] = (),
    part_cols: Sequence[str] = (),
    parts: DataFrame | None = None,
) -> DataFrame:
    """Add unmatched documents with score 0 where they can enter a query's top k (§4 shape 3).

    Every document a query does not match scores 0, and ties go to the smaller doc_id. The
    first ``top_k`` unmatched documents of a query in doc_id order lie among the first
    ``top_k + m`` documents of its collection (m = matched count), so only queries with fewer
    than ``top_k`` positive scores get ``top_k + m`` candidate ordinals; an equi-join on the
    per-collection document ordinal turns them into ids. Exact, and linear in the output.
    ``parts`` (columns ``part_cols``) repeats the fill for each parameter combination.
    """
    keys = list(collection_cols)
    qk = _qkeys(keys)
    q = queries.withColumn("query_id", F.col("query_id").cast("string")).select(*qk).distinct()
    if parts is not None:
        q = q.select(*qk, F.inline(_grid_structs(part_cols, parts)))
    per_q = scores.groupBy(*part_cols, *qk).agg(
        F.count(F.lit(1)).alias("_rf_m"), F.count_if(F.col("score") > 0).alias("_rf_pos")
    )
    need = (
        q.join(per_q, list(part_cols) + qk, "left")
        .fillna(0, ["_rf_m", "_rf_pos"])
        .filter(F.col("_rf_pos") < top_k)
    )
    ords = global_ordinal(tok_docs.select(*keys, "doc_id", _ROW), keys + ["doc_id", _ROW], out="_rf_g")
    if keys:
        first = ords.groupBy(*keys).agg(F.min("_rf_g").alias("_rf_first"))
        ords = ords.join(first, keys).withColumn("_rf_g", F.col("_rf_g") - F.col("_rf_first") + 1)
    ords = ords.select(*keys, "doc_id", _ROW, F.col("_rf_g").alias("_rf_ord"))
    cand = need.select(*part_cols, *qk, F.explode(F.sequence(F.lit(1), F.lit(top_k) + F.col("_rf_m"))).alias("_rf_ord"))
    fill = (
        cand.join(ords, keys + ["_rf_ord"])
        .join(scores.select(*part_cols, *qk, "doc_id", _ROW), list(part_cols) + qk + ["doc_id", _ROW], "left_anti")
        .select(*part_cols, *qk, "doc_id", _ROW, F.lit(0.0).alias("score"))
    )
    return scores.select(*part_cols, *qk, "doc_id", _ROW, "score").unionByName(fill)


def _rounded_scores(scores: DataFrame, digits: int | None) -> DataFrame:
    """Rounding before ranking keeps last-bit differences of distributed sums from flipping ranks."""
    return scores if digits is None else scores.withColumn("score", F.round("score", digits))


def _finish_run(scores, top_k, run_name, collection_cols, part_cols=()):
    keep = [c for c in collection_cols if c != "query_id"] + list(part_cols)
    return make_ranked_run(scores, "score", run_name, top_k, partition_cols=keep)


def bm25_search(
    docs: DataFrame,
    queries: DataFrame,
    top_k: int | None = 1000,
    k1: float = 1.5,
    b: float = 0.75,
    epsilon: float = 0.25,
    run_name: str | Column = "bm25",
    collection_cols: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
    fill_zeros: bool = True,
    doc_row_col: str | None = None,
    score_digits: int | None = None,
) -> DataFrame:
    """BM25 (Okapi, epsilon floor) run: query_id, Q0, doc_id, rank, score, run_name.

    ``fill_zeros`` ranks unmatched documents with score 0 inside the cut; without a cut-off
    (``top_k=None``) only documents sharing a query term are ranked.
    """
    td = tokenized_docs(docs, collection_cols, tokenizer, row_col=doc_row_col)
    scores, nonnegative = bm25_scores(docs, queries, BM25Params(k1, b, epsilon), collection_cols, tokenizer, tok_docs=td, top_k=top_k, score_digits=score_digits)
    scores = _rounded_scores(scores, score_digits)
    if fill_zeros and top_k:
        fill = fill_first_documents if nonnegative else fill_zero_scores
        scores = fill(scores, td, queries, top_k, collection_cols)
    return _finish_run(scores, top_k, run_name, collection_cols)


# ---------------------------------------------------------------- TF-IDF

def tfidf_scores(
    docs: DataFrame,
    queries: DataFrame,
    collection_cols: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
    tok_docs: DataFrame | None = None,
    top_k: int | None = None,
    score_digits: int | None = None,
) -> DataFrame:
    """(keys, query_id, doc_id, _rf_row, score): cosine of raw-tf x smooth-idf vectors. ``top_k``, ``score_digits``: as in ``bm25_scores``.

    One pass over the documents' own term counts (run lengths of the sorted tokens) gives both the document norm (every
    term) and the document's query-term entries (``collect_list`` of the flagged terms, bounded by the query
    vocabulary). Its only exchange is the one on the document, none where the collection is clustered by it.
    """
    keys = list(collection_cols)
    td = tok_docs if tok_docs is not None else tokenized_docs(docs, collection_cols, tokenizer)
    index = build_index(td, keys)
    idf = index.with_stats(index.terms).select(*keys, "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    qt = query_terms(queries, keys, tokenizer).join(idf, keys + ["term"])  # unknown terms drop
    qk = _qkeys(keys)
    qnorm = qt.groupBy(*qk).agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("qnorm"))
    qw = qt.join(qnorm, qk).select(*qk, "term", (F.col("qtf") * F.col("idf") * F.col("idf") / F.col("qnorm")).alias("qw"))
    wanted = checked_broadcast(qt.select(*keys, "term").distinct().withColumn("_rf_q", F.lit(True)))
    # every term of a document is in the vocabulary, so one that the table below lacks stands in one document: their idf is one
    # number a collection, and the table, without them, stays small enough to meet the postings map-side for far longer
    weighed = index.with_stats(index.terms).filter("df > 1").select(*keys, "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    once = F.log((1 + F.col("n_docs")) / 2) + 1
    # a document counts its own terms inside its row, so no (document, term) rows are shuffled for the counts
    postings = td.select(*keys, "doc_id", _ROW, F.explode_outer(term_counts("tokens")).alias("_p")).filter(F.col("_p").isNotNull()).select(
        *keys, "doc_id", _ROW, F.col("_p.term").alias("term"), F.col("_p.tf").alias("tf"))
    # a vocabulary under the checked bound joins map-side; above it, a shuffle join (AQE splits
    # hot terms)
    alone = index.stats.select(*keys, once.alias("_rf_once")) if keys else None
    known = postings.join(F.broadcast(alone), keys) if keys else index.with_stats(postings).withColumn("_rf_once", once)
    per_doc = (
        known.join(checked_broadcast(weighed), keys + ["term"], "left").withColumn("idf", F.coalesce("idf", "_rf_once"))
        .join(wanted, keys + ["term"], "left")
        .groupBy(*keys, "doc_id", _ROW)
        .agg(
            F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("dnorm"),
            F.collect_list(F.when(F.col("_rf_q"), F.struct("term", "tf"))).alias("_rf_m"),
        )
    )
    if top_k and fits(td, keys) and within_bound(qt, QUERY_ROWS):
        rows = qw.select(*_side_key(keys), "query_id", "term", "qw").collect()
        listed = per_doc.select(*keys, "doc_id", _ROW, F.col("_rf_m.term").alias("terms"), F.col("_rf_m.tf").alias("tfs"), F.col("dnorm").alias("norm"))
        return block_scores(listed, QuerySide([tuple(r) for r in rows], {}), keys, _ROW, None, top_k, _margin(score_digits))
    tasks = pair_tasks(index, qt)
    if tasks > 1:
        per_doc = per_doc.repartition(max(tasks, td.sparkSession.sparkContext.defaultParallelism), *keys, "doc_id")
    matched = per_doc.select(*keys, "doc_id", _ROW, "dnorm", F.explode("_rf_m").alias("_m")).select(
        *keys, "doc_id", _ROW, "dnorm", F.col("_m.term").alias("term"), F.col("_m.tf").alias("tf"))
    contrib = matched.join(checked_broadcast(qw), keys + ["term"])
    scores = contrib.groupBy(*qk, "doc_id", _ROW).agg(
        (F.sum(F.col("qw") * F.col("tf")) / F.first("dnorm")).alias("score"))
    return scores


def tfidf_search(
    docs: DataFrame,
    queries: DataFrame,
    top_k: int | None = 1000,
    run_name: str | Column = "tfidf",
    collection_cols: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
    fill_zeros: bool = True,
    score_digits: int | None = None,
) -> DataFrame:
    """TF-IDF (raw tf, smooth idf, L2 both sides, dot) run."""
    td = tokenized_docs(docs, collection_cols, tokenizer)
    scores = _rounded_scores(tfidf_scores(docs, queries, collection_cols, tokenizer, tok_docs=td, top_k=top_k, score_digits=score_digits), score_digits)
    if fill_zeros and top_k:  # cosine scores are never negative
        scores = fill_first_documents(scores, td, queries, top_k, collection_cols)
    return _finish_run(scores, top_k, run_name, collection_cols)
