"""Hard-negative mining by angular triangle filtering (operator 13).

Vectors are quantised to integers; scores are integer inner products. Each vector stores its angles to a few reference directions.
For two vectors the angles to one reference bound the angle between them from both sides (triangle inequality on the sphere); the
cosines of these bounds, times both norms and widened by a margin above all rounding, enclose the score. Integer scoring is done only
where this interval meets the window that is searched: at or above the least score that can still be a positive, or inside
the windows of an anchor's positives. The bounds save work and never decide: whatever they let through is scored exactly.

Layout: rows are range-partitioned by label and angle and packed into blocks of bounded size (binary matrices) that hold one label;
anchors likewise. Pairs of blocks are chosen from one summary row per block (label, ranges of angles and norms), then meet
their matrices in two equi-joins, and every pair is one row of work: nothing is grouped without a bound, and no vector passes
the driver but a sample of bounded size from which the reference directions are taken.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import arrow_batches, read_table

MEASURED = "id long, label string, anchor boolean, q binary, norm double, angles array<double>, lead double"
BLOCK = (
    "block long, label string, n int, ids binary, q binary, norms binary, angles binary, "
    "low_angles array<double>, high_angles array<double>, low_norm double, high_norm double"
)
# Above the rounding of an angle near 0 or pi (the square root of that of a cosine), in shares of the product of the norms.
SHARE, LEAST = 1e-6, 1e-3
# Norms below this keep every inner product inside 64-bit integers.
MOST = 2.0**31


def references(vectors: np.ndarray, labels: list[str], n: int) -> tuple[np.ndarray, dict[str, int]]:
    """``n`` unit directions from a sample: means of the commonest labels, then single vectors; the place of each label's mean."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    names, counts = np.unique(np.array(labels, object).astype(str), return_counts=True)
    chosen, place = [], {}
    for name in names[np.lexsort((names, -counts))][: max(1, n // 2)]:
        mean = unit[[x == name for x in labels]].mean(axis=0)
        if np.linalg.norm(mean) > 1e-9:
            place[str(name)] = len(chosen)
            chosen.append(mean / np.linalg.norm(mean))
    chosen += [u for u in unit if u.any()][: n - len(chosen)]
    return np.array(chosen or [np.eye(1, unit.shape[1])[0]]), place


def _measure(dim: int, scale: float, refs: np.ndarray, place: dict[str, int]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("v")
            flat, edges = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes, q = np.diff(edges), np.zeros((batch.num_rows, dim))
            q[np.arange(dim) < sizes[:, None]] = np.floor(scale * flat)
            norm = np.linalg.norm(q, axis=1)
            fits = norm < MOST
            q, norm = q[fits], norm[fits]
            cosine = (q @ refs.T) / np.maximum(norm, 1e-300)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
            labels = [x for x, ok in zip(batch.column("label").to_pylist(), fits) if ok]
            lead = angles[np.arange(len(labels)), [place.get(x, 0) for x in labels]]
            keep = lambda name: batch.column(name).filter(pa.array(fits))
            raw = q.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [keep("id"), pa.array(labels, pa.string()), keep("anchor"), pa.array([r.tobytes() for r in raw], pa.binary()),
                 pa.array(norm), pa.array(list(angles), pa.list_(pa.float64())), pa.array(lead)],
                ["id", "label", "anchor", "q", "norm", "angles", "lead"],
            )

    return run


def _pack(rows: int):
    """Blocks of at most ``rows`` neighbouring rows of one label."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block():
            nonlocal made, held
            t = pa.Table.from_batches(held).combine_chunks()
            angles = np.array(t.column("angles").to_pylist(), "<f8").reshape(t.num_rows, -1)
            norms = t.column("norm").to_numpy()
            held, made = [], made + 1
            return [
                (part << 32) + made, t.column("label")[0].as_py(), t.num_rows, t.column("id").to_numpy().astype("<i8").tobytes(),
                b"".join(t.column("q").to_pylist()), norms.astype("<f8").tobytes(), angles.tobytes(),
                angles.min(axis=0).tolist(), angles.max(axis=0).tolist(), float(norms.min()), float(norms.max()),
            ]

        def out(x):
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2, pa.float64(), pa.float64()]
            names = [f.split()[0] for f in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, types)], names)

        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            at = 0
            while at < batch.num_rows:
                size = sum(b.num_rows for b in held)
                if held and (size == rows or held[0].column("label")[0].as_py() != labels[at]):
                    yield out(block())
                    size = 0
                other = np.nonzero(labels[at:] != labels[at])[0]
                n = min(rows - size, int(other[0]) if len(other) else batch.num_rows - at)
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield out(block())

    return run


class _Block:
    """The matrices of one side of a pair."""

    def __init__(self, row: dict, side: str):
        n = row[f"{side}_n"]
        self.ids = np.frombuffer(row[f"{side}_ids"], "<i8")
        self.q = np.frombuffer(row[f"{side}_q"], "<i4").reshape(n, -1)
        self.norms = np.frombuffer(row[f"{side}_norms"], "<f8")
        angles = np.frombuffer(row[f"{side}_angles"], "<f8").reshape(n, -1)
        self.cos, self.sin = self.norms[:, None] * np.cos(angles), self.norms[:, None] * np.sin(angles)


def score_bounds(a: _Block, x: _Block, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score that each of the anchors ``at`` can have with each row.

    With angles s and t to a reference, the angle between two vectors is at least |s - t| and at most min(s + t, 2 pi - s - t); the cosines
    are cos s cos t + sin s sin t and cos s cos t - sin s sin t, and the stored factors hold the norms already.
    """
    high = low = None
    for j in range(a.cos.shape[1]):
        p, r = np.outer(a.cos[at, j], x.cos[:, j]), np.outer(a.sin[at, j], x.sin[:, j])
        high = p + r if high is None else np.minimum(high, p + r)
        low = p - r if low is None else np.maximum(low, p - r)
    slack = SHARE * np.outer(a.norms[at], x.norms) + LEAST
    return np.ceil(low - slack), np.floor(high + slack)


def integer_scores(a: _Block, x: _Block, at: slice, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that some anchor wants, and the exact scores with them (int64)."""
    cols = np.nonzero(wanted.any(axis=0))[0]
    left, right = a.q[at], x.q[cols]
    if a.norms.max(initial=0) * x.norms.max(initial=0) < 2.0**52:  # every partial sum is an exact double
        return cols, np.rint(left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return cols, left.astype(np.int64) @ right.astype(np.int64).T


def best_positives(a: _Block, x: _Block, k: int, step: int = 128):
    """(anchor place, row id, score) of the first ``k`` other rows of a block for each anchor, by score and then id."""
    for start in range(0, len(a.ids), step):
        at = slice(start, start + step)
        low, high = score_bounds(a, x, at)
        own = a.ids[at, None] == x.ids
        low[own] = high[own] = -np.inf
        # a row below the k-th greatest lower bound cannot be among the first k
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        wanted = (high >= least[:, None]) & ~own
        cols, scores = integer_scores(a, x, at, wanted)
        for i, s in enumerate(scores):
            own_cols = np.nonzero(wanted[i, cols])[0]
            if len(own_cols) > k:
                cut = np.partition(s[own_cols], -k)[-k]
                own_cols = own_cols[s[own_cols] >= cut]
            ids = x.ids[cols[own_cols]]
            for j in np.lexsort((ids, -s[own_cols]))[:k]:
                yield start + i, int(ids[j]), int(s[own_cols[j]])


def best_negatives(a: _Block, x: _Block, windows: dict[int, list[tuple[int, int, int]]], k: int, step: int = 128):
    """(anchor place, number of the window, row id, score) of the first ``k`` rows of a block in each ``(number, low, high)`` window."""
    none = [(0, 1, 0)]
    for start in range(0, len(a.ids), step):
        at = slice(start, start + step)
        n = len(a.ids[at])
        floor = np.array([min(w[1] for w in windows.get(start + i, none)) for i in range(n)], np.int64)
        ceiling = np.array([max(w[2] for w in windows.get(start + i, none)) for i in range(n)], np.int64)
        live = np.array([start + i in windows for i in range(n)])
        low, high = score_bounds(a, x, at)
        wanted = (high >= floor[:, None]) & (low <= ceiling[:, None]) & live[:, None]
        cols, scores = integer_scores(a, x, at, wanted)
        for i in np.nonzero(live)[0]:
            s = scores[i]
            inside = np.nonzero((s >= floor[i]) & (s <= ceiling[i]))[0]
            if not len(inside):
                continue
            ids = x.ids[cols[inside]]
            order = np.lexsort((ids, -s[inside]))
            ids, down = ids[order], s[inside][order]
            for number, least, most in windows[start + i]:
                first = int(np.searchsorted(-down, -most))
                for j in range(first, min(first + k, len(down))):
                    if down[j] < least:
                        break
                    yield start + int(i), number, int(ids[j]), int(down[j])


def _work(kind: str, k: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                a, x = _Block(r, "a"), _Block(r, "x")
                if kind == "positives":
                    found = [(r["a_block"], i, int(a.ids[i]), 0, *rest) for i, *rest in best_positives(a, x, k)]
                else:
                    windows: dict[int, list] = {}
                    for w in r["windows"]:
                        windows.setdefault(w["place"], []).append((w["number"], w["least"], w["most"]))
                    found = [(r["a_block"], i, int(a.ids[i]), *rest) for i, *rest in best_negatives(a, x, windows, k)]
                columns = zip(*found) if found else [[]] * 6
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "place", "anchor_id", "number", "row_id", "score"])

    return run


FOUND = "block long, place int, anchor_id long, number int, row_id long, score long"


def _side(blocks: DataFrame, side: str, *more: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "n", "ids", "q", "norms", "angles")], *more)


def _summary(blocks: DataFrame, side: str, *more: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "label", "low_angles", "high_angles", "low_norm", "high_norm")], *more)


def _meets(low: Column, high: Column) -> Column:
    """Whether the scores of two blocks, bounded by their ranges of angles and norms, can lie between ``low`` and ``high``."""
    ranges = F.arrays_zip("a_low_angles", "a_high_angles", "x_low_angles", "x_high_angles")
    pi = F.lit(math.pi)

    def nearest(r):
        return F.cos(F.greatest(F.lit(0.0), r["a_low_angles"] - r["x_high_angles"], r["x_low_angles"] - r["a_high_angles"]))

    def farthest(r):
        first, last = r["a_low_angles"] + r["x_low_angles"], r["a_high_angles"] + r["x_high_angles"]
        return F.when((first <= pi) & (last >= pi), F.lit(-1.0)).otherwise(F.least(F.cos(first), F.cos(last)))

    top, bottom = F.array_min(F.transform(ranges, nearest)), F.array_max(F.transform(ranges, farthest))
    most, least = F.col("a_high_norm") * F.col("x_high_norm"), F.col("a_low_norm") * F.col("x_low_norm")
    slack = most * SHARE + LEAST
    upper = top * F.when(top >= 0, most).otherwise(least) + slack
    lower = bottom * F.when(bottom >= 0, least).otherwise(most) - slack
    return (upper >= low) & (lower <= high)


def _block_pairs(anchors: DataFrame, rows: DataFrame, per_chunk: int = 256) -> DataFrame:
    """All pairs of an anchor block's and a row block's summary, by an equi-join on chunks of the row blocks."""
    chunks = max(1, -(-rows.count() // per_chunk))
    chunk = F.pmod(F.xxhash64("x_block"), F.lit(chunks))
    return anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(
        rows.withColumn("chunk", chunk), "chunk"
    )


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows by score and id for each key, cut on the map side too, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: float = 256.0,
    n_references: int = 8,
    sample_rows: int = 4096,
    block_rows: int = 4096,
    anchor_rows: int = 1024,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``anchor`` (default: all).

    Components become ``floor(scale * x)``; a score is the integer inner product. An anchor's positives are the first ``n_positives`` other
    rows of its label by score, then smaller id; for each positive come the first ``n_negatives`` rows of other labels with
    ``low_percent * positive <= 100 * negative <= high_percent * positive``, ``rank`` counting from 1. A positive without such a row gives none.

    Rows with a null id, label or vector, or with a null or non-finite component take no part, nor do rows whose quantised norm is 2^31 or
    more (scores are 64-bit). Shorter vectors count as filled with zeros. Of several rows with one id the one with the smallest label (as text), then vector
    takes part (exact repeats count once). An empty table, no anchors or one label give no rows. Only the named columns are read, so
    other columns cannot clash. ``n_references``, ``sample_rows``, ``block_rows`` and ``anchor_rows`` change the work, never the result.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    base = vectors.select(
        vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"),
        vectors[vector_col].cast("array<double>").alias("v"), (F.lit(True) if anchor is None else F.coalesce(anchor, F.lit(False))).alias("anchor"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    n, ids, dim = base.agg(F.count("*"), F.count_distinct("id"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    if ids < n:
        one = base.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r"))
        base = one.select("id", "r.label", "r.v", "r.anchor")
    sample = base.select("label", "v").sample(min(1.0, sample_rows / n), seed=5).limit(2 * sample_rows).collect()
    floats = np.zeros((len(sample), max(dim, 1)))
    for i, r in enumerate(sample):
        floats[i, : len(r.v)] = r.v
    refs, place = references(floats, [r.label for r in sample], n_references)

    with arrow_batches(spark, rows=4096, megabytes=16):
        measured = base.mapInArrow(_measure(max(dim, 1), scale, refs, place), MEASURED).checkpoint()

        def blocks(rows, size):
            parts = max(1, -(-rows.count() // size))
            order = ["label", "lead", "id"]
            return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack(size), BLOCK).checkpoint()

        row_blocks, anchor_blocks = blocks(measured, block_rows), blocks(measured.filter("anchor"), anchor_rows)
    x_side, x_summary = _side(row_blocks, "x"), _summary(row_blocks, "x")
    # a few rows of much work: their number of tasks must not follow their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    with arrow_batches(spark, rows=4, megabytes=16):
        same = _summary(anchor_blocks, "a").join(x_summary, F.col("a_label") == F.col("x_label")).select("a_block", "x_block")
        work = same.join(_side(anchor_blocks, "a"), "a_block").repartition(tasks, "x_block").join(x_side, "x_block")
        met = work.mapInArrow(_work("positives", n_positives), FOUND)
        positives = _first(met, ["anchor_id"], n_positives).select(
            "block", "place", "anchor_id", F.col("rank").cast("int").alias("number"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")
        ).checkpoint()

        share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(6,0)") / F.lit(100).cast("decimal(3,0)")
        least, most = F.ceil(share(low_percent)), F.floor(share(high_percent))
        windows = positives.select("block", "place", "number", least.cast("long").alias("least"), most.cast("long").alias("most")).filter("least <= most")
        # at most ``anchor_rows * n_positives`` windows in a list
        listed = windows.groupBy("block").agg(
            F.collect_list(F.struct("place", "number", "least", "most")).alias("windows"), F.min("least").alias("least"), F.max("most").alias("most")
        )
        open_blocks = anchor_blocks.join(listed, "block")
        pairs = _block_pairs(_summary(open_blocks, "a", "least", "most"), x_summary)
        other = pairs.filter((F.col("a_label") != F.col("x_label")) & _meets(F.col("least"), F.col("most"))).select("a_block", "x_block")
        work = other.join(_side(open_blocks, "a", "windows"), "a_block").repartition(tasks, "x_block").join(x_side, "x_block")
        met = work.mapInArrow(_work("negatives", n_negatives), FOUND)
        negatives = _first(met, ["anchor_id", "number"], n_negatives).checkpoint()
    return negatives.join(positives.select("anchor_id", "number", "positive_id", "positive_score"), ["anchor_id", "number"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), anchor=F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
