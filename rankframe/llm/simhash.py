"""SimHash near-duplicate classes by pigeonhole blocks (operator 2).

Fingerprints are computed in Arrow batches. Equal fingerprints fall together in one aggregate, so a group of
exact copies costs one row from there on. The distinct fingerprints are split into ``d + 2`` blocks of
bits: two fingerprints that differ in at most ``d`` bits agree on two blocks at least, so they meet under
one of the C(d + 2, 2) keys made of two blocks. Inside a key's bucket every fingerprint is compared by
Hamming distance, and the bucket returns only a spanning forest of its links, never its pairs.

Buckets of more than ``bucket_rows`` fingerprints are dealt again under keys that also fix ``8 - 3`` of 8 blocks
of the remaining bits (``d + 5`` in general); two close fingerprints agree on those, too, and such a
bucket cannot hold more than about 2**15 distinct fingerprints however large the input is.
"""
from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import connected_components, free_names, read_table, text_batches

SEED = 42


def simhash(text: str | None, shingle: int) -> int:
    """64-bit SimHash: bit set when set in over half of the shingles' XXH64 values."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(shingle: int):
    """Arrow-batched column function: text -> fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], "<u8").view("<i8"))

    return fingerprint


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit positions, of nearly equal width."""
    return [sum(1 << int(b) for b in run) for run in np.array_split(bits, parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(distance: int) -> list[int]:
    """One mask for each pair of the ``distance + 2`` blocks."""
    return [a | b for a, b in combinations(_cut(list(range(64)), distance + 2), 2)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks over the bits that ``mask`` leaves free: each keeps 5 of ``distance + 5`` blocks of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(c) for c in combinations(_cut(free, distance + 5), 5)]


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links (at most ``distance`` differing bits) among distinct fingerprints."""
    left, a, b = np.unique(fps).view(np.uint64), [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            close = np.bitwise_count(left ^ queue.pop()) <= distance
            if close.any():
                found, left = left[close], left[~close]
                queue.extend(found)
                a.append(np.full(len(found), root))
                b.append(found)
    empty = np.empty(0, np.uint64)
    return np.concatenate([*a, empty]), np.concatenate([*b, empty])


def _links(distance: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("fps")
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()  # one array for all buckets, cut by offsets
            found = [forest(flat[a:b], distance) for a, b in zip(edges[:-1], edges[1:])]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(fps: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """Links ``(a, b)`` that connect what is connected among distinct fingerprints ``fp``."""
    masks = block_masks(distance)
    fp = F.col("fp")
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("c"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
        ).alias("x"),
    ).select("fp", "x.c", "x.k")
    counts = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(counts, ["c", "k"])  # an equi-join: a hot bucket's rows can be split
    few = met.filter(F.col("n") <= bucket_rows).select("fp", "c", "k", F.lit(0).alias("s"), F.lit(0).cast("long").alias("t"))
    finer = F.element_at(
        F.array(*[F.array(*[F.lit(_signed(f)) for f in finer_masks(m, distance)]) for m in masks]), F.col("c") + 1
    )
    many = (
        met.filter(F.col("n") > bucket_rows)
        .select("fp", "c", "k", F.posexplode(finer).alias("s", "t"))
        .withColumn("t", fp.bitwiseAND(F.col("t")))
        .withColumn("s", F.col("s") + 1)
    )
    buckets = few.unionByName(many).groupBy("c", "k", "s", "t").agg(F.collect_list("fp").alias("fps"))
    return buckets.filter(F.size("fps") > 1).select("fps").mapInArrow(_links(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 3,
    bucket_rows: int = 4096,
) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fp`` (long), ``root`` (long) and ``component_id``.

    ``root`` is the class of linked fingerprints, ``component_id`` its smallest id. Null and blank texts have
    fingerprint zero and link like any other; null ids are ignored by the minimum (null if the
    class has no other); repeated rows are kept; an empty table gives no rows; only the two named columns
    are read, so other columns cannot clash.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text_batches(docs.sparkSession)
    base = docs.select(
        docs[id_col].alias("doc_id"),
        F.xxhash64(docs[text_col]).alias("text_hash"),
        fingerprint_column(shingle)(docs[text_col]).alias("fp"),
    ).checkpoint()
    fps = base.groupBy("fp").agg(F.min("doc_id").alias("low")).checkpoint()
    classes = connected_components(links(fps.select("fp"), max_distance, bucket_rows))
    rooted = fps.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return base.join(rooted.select("fp", "root").join(lows, "root"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` (all columns), one for each near-duplicate class: the one with the smallest id.

    Null ids come last; among rows with equal id and text one stays.
    """
    ident, hashed, place = free_names(docs.columns, "id", "hash", "n")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    kept = (
        near_duplicates(docs, id_col, text_col, **params)
        .groupBy("root")
        .agg(F.min(order).alias("k"))
        .select(F.coalesce(F.col("k.doc_id").cast("string"), F.lit("")).alias(ident), F.col("k.text_hash").alias(hashed))
    )
    # plain equality on two columns: the window below needs no second exchange of the texts
    keyed = docs.withColumns({ident: F.coalesce(docs[id_col].cast("string"), F.lit("")), hashed: F.xxhash64(docs[text_col])})
    first = Window.partitionBy(ident, hashed).orderBy(hashed)
    left = keyed.join(kept, [ident, hashed], "left_semi").withColumn(place, F.row_number().over(first))
    return left.filter(F.col(place) == 1).select(*docs.columns)


def op2_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
