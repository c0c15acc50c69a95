"""Scores of many (query, document) pairs without a row per pair and term.

A join of postings with query terms makes a row for every term that a query and a document share, and a hash sum over them. Here a task reads its
documents in Arrow batches and adds up the same products in arrays, documents by queries, a bounded slice at a time. The query side (one row per
query and term, bounded by the caller) is read by every task. With ``top_k`` a task keeps the first rows of each query, and every row that ties with
the last of them within ``margin``, so the ranking of the caller finds the same rows as among all pairs.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of the query side that tasks may read, rows that a task may hold for its first ones, and products or cells added up at a time.
QUERY_ROWS = 500_000
HELD_ROWS = 2_000_000
SLICE = 2_000_000


def fits(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether documents of ``df`` can be scored here: at most one collection key, a string."""
    return len(keys) < 2 and all(isinstance(df.schema[k].dataType, T.StringType) for k in keys)


class QuerySide:
    """(key, query, term, weight) rows as arrays: the entries of one (key, term) stand together, and the queries of a key are numbered from 0."""

    def __init__(self, rows: Sequence[tuple], stats: dict):
        rows = sorted(rows, key=lambda r: (r[0], r[2], r[1] is not None, r[1] or ""))
        self.keys = sorted({r[0] for r in rows})
        self.avgdl = np.array([stats.get(k) or 0.0 for k in self.keys], float)
        self.terms = sorted({r[2] for r in rows})
        key_at, term_at = ({x: i for i, x in enumerate(v)} for v in (self.keys, self.terms))
        queries = sorted({(key_at[r[0]], r[1] is not None, r[1] or "") for r in rows})
        self.query_ids = [q if given else None for _, given, q in queries]
        self.query_key = np.array([k for k, _, _ in queries], np.int64)
        own, place = np.bincount(self.query_key, minlength=len(self.keys)), {}
        first = np.cumsum(own) - own
        for i, q in enumerate(queries):
            place[q] = i - int(first[q[0]])
        self.first, self.most = first, int(own.max(initial=1))
        code = np.array([key_at[r[0]] * len(self.terms) + term_at[r[2]] for r in rows], np.int64)
        self.local = np.array([place[key_at[r[0]], r[1] is not None, r[1] or ""] for r in rows], np.int64)
        self.weight = np.array([r[3] for r in rows], float)
        self.codes, self.start, self.many = np.unique(code, return_index=True, return_counts=True)


class _Best:
    """Rows (query, score, document) seen so far; of each query the first ``k`` and their ties are kept."""

    def __init__(self, queries: int, k: int, margin: float):
        self.k, self.margin, self.low = k, margin, np.full(queries, -np.inf)
        self.held, self.n, self.most = [], 0, max(2 * k * queries, SLICE)

    def add(self, q, s, ids, rows):
        keep = np.flatnonzero(s >= self.low[q])
        self.held.append((q[keep], s[keep], ids.take(pa.array(keep)), rows[keep]))
        self.n += len(keep)
        if self.n > self.most:
            self.prune()
            self.most = max(self.most, 2 * self.n)

    def prune(self):
        if not self.held:
            return
        q, s, rows = (np.concatenate([h[i] for h in self.held]) for i in (0, 1, 3))
        ids = pa.concat_arrays([h[2] for h in self.held])
        order = np.lexsort((-s, q))
        many = np.bincount(q, minlength=len(self.low))
        full = np.flatnonzero(many >= self.k)
        self.low[full] = s[order[(np.cumsum(many) - many)[full] + self.k - 1]] - self.margin
        keep = np.flatnonzero(s >= self.low[q])
        self.held, self.n = [(q[keep], s[keep], ids.take(pa.array(keep)), rows[keep])], len(keep)


def _slices(batch: pa.RecordBatch, side: QuerySide, terms: pa.Array, k1: float | None, b: float):
    """(query, score, document number) arrays of the pairs of a batch, some documents at a time."""
    n = batch.num_rows
    if "key" in batch.schema.names:
        key = pc.fill_null(pc.index_in(batch.column("key"), value_set=pa.array(side.keys, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        key = np.zeros(n, np.int64)
    lists = batch.column("terms")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), size)
    known = np.flatnonzero((at >= 0) & (key[doc] >= 0))
    doc, code = doc[known], key[doc[known]] * len(side.terms) + at[known]
    if "tfs" in batch.schema.names:
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(float)[known]
    else:
        both, tf = np.unique(doc * (len(side.keys) * len(side.terms)) + code, return_counts=True)
        doc, code, tf = both // (len(side.keys) * len(side.terms)), both % (len(side.keys) * len(side.terms)), tf.astype(float)
    where = np.minimum(np.searchsorted(side.codes, code), len(side.codes) - 1)
    met = np.flatnonzero(side.codes[where] == code)
    doc, tf, where = doc[met], tf[met], where[met]
    norm = batch.column("norm").to_numpy(zero_copy_only=False).astype(float)
    if k1 is None:
        worth = tf
    else:
        worth = tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm[doc] / side.avgdl[key[doc]]))
    many, begin = side.many[where], 0
    # documents [from, to) whose products and cells fit a slice
    products = np.concatenate([[0], np.cumsum(np.bincount(doc, many, n).astype(np.int64))])
    entry = np.searchsorted(doc, np.arange(n + 1))
    while begin < n:
        end = int(np.searchsorted(products, products[begin] + SLICE, "right")) - 1
        end = max(begin + 1, min(end, begin + max(1, SLICE // side.most), n))
        e = slice(entry[begin], entry[end])
        m = many[e]
        if len(m):
            place = np.repeat(side.start[where[e]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            cell = np.repeat((doc[e] - begin) * side.most, m) + side.local[place]
            total = np.bincount(cell, np.repeat(worth[e], m) * side.weight[place], (end - begin) * side.most)
            seen = np.zeros(len(total), bool)
            seen[cell] = True
            cell = np.flatnonzero(seen)
            d = cell // side.most + begin
            s = total[cell] if k1 is not None else total[cell] / norm[d]
            yield side.first[key[d]] + cell % side.most, s, d
        begin = end


def block_scores(docs: DataFrame, side: QuerySide, keys: Sequence[str], row_col: str, bm25: tuple[float, float] | None = None, top_k: int | None = None,
                 margin: float = 0.0) -> DataFrame:
    """(keys, query_id, doc_id, ``row_col``, score) of every document and query that share a term, or a superset of each query's ``top_k`` rows.

    ``docs``: ``doc_id``, ``row_col``, ``terms`` (an array, with ``tfs`` beside it each term's count, else repeated terms are counted), ``norm`` and the
    collection key. With ``bm25`` = (k1, b), ``norm`` is the length and a term is worth its saturated count; without, a term is worth its count and the
    sum is divided by ``norm``."""
    key = keys[0] if keys else None
    shared = docs.sparkSession.sparkContext.broadcast(side)
    cut = top_k is not None and top_k * len(side.query_ids) <= HELD_ROWS
    names = [*([key] if key and key != "query_id" else []), "query_id", "doc_id", row_col, "score"]
    schema = T.StructType([T.StructField(c, T.LongType() if c == row_col else T.DoubleType() if c == "score" else T.StringType()) for c in names])

    def made(q, s, ids, rows):
        side = shared.value
        for i in range(0, len(q), 100_000):
            own = slice(i, i + 100_000)
            query = pa.array(side.query_ids, pa.string()).take(pa.array(q[own]))
            columns = {"query_id": query, "doc_id": ids.slice(i, 100_000), row_col: pa.array(rows[own], pa.int64()), "score": pa.array(s[own], pa.float64())}
            if key and key != "query_id":
                columns[key] = pa.array(side.keys, pa.string()).take(pa.array(side.query_key[q[own]]))
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    def run(batches):
        side = shared.value
        best = _Best(len(side.query_ids), top_k, margin) if cut else None
        terms = pa.array(side.terms, pa.string())
        for batch in batches:
            if not batch.num_rows or not side.terms:
                continue
            all_rows = batch.column(row_col).to_numpy(zero_copy_only=False)
            for q, s, d in _slices(batch, side, terms, *(bm25 or (None, 0.0))):
                ids, rows = batch.column("doc_id").take(pa.array(d)), all_rows[d]
                if cut:
                    best.add(q, s, ids, rows)
                else:
                    yield from made(q, s, ids, rows)
        if cut:
            best.prune()
            for held in best.held:
                yield from made(*held)

    own = [F.col(key).alias("key")] if key else []
    extra = ["tfs"] if "tfs" in docs.columns else []
    return docs.select(*own, "doc_id", row_col, "terms", *extra, F.col("norm").cast("double").alias("norm")).mapInArrow(run, schema)
