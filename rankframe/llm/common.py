"""Helpers shared by the training-data operators."""
from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Word and white-space classes of the contracts: ASCII white space only.
SPACE = r"\x20\x09-\x0D"
WORD_SPLIT = f"[{SPACE}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables; also registers the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Send at most ``rows`` texts and about ``megabytes`` at once to Python workers (session settings), which bounds
    their memory; lower settings of the user stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    # the value as Spark reads it: a number and perhaps a unit
    name, units = "spark.sql.execution.arrow.maxBytesPerBatch", {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number, unit = re.match(r"(-?\d+)([bkmg]?)", spark.conf.get(name).strip().lower()).groups()
    if not 0 < int(number) * units[unit] <= megabytes << 20:
        spark.conf.set(name, f"{megabytes}m")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, megabytes: int):
    """Within the block, jobs send at most ``rows`` rows and about ``megabytes`` at once to Python workers; the settings are put back after it.

    For plans that are run inside the block (written or checkpointed)."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{megabytes}m"}
    old = {name: spark.conf.get(name) for name in new}
    try:
        for name, value in new.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def free_names(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` column names, each lengthened by underscores until it differs (in any case) from all of ``names``."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it as a lambda variable in ``body``.

    Expressions inside a higher-order function are evaluated once per element; binding them
    first keeps them at once per row.
    """
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """Exclusive prefix sums of an array<long>, in O(n * sqrt(n)) and without copying the array.

    Blocks of about sqrt(n) elements are summed first; each element then adds the blocks before it
    (already summed) and the elements before it inside its block.
    """
    zero = F.lit(0).cast("long")

    def add(a, b):
        return a + b

    def blocks(s):
        return F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(s["v"]) / s["b"]).cast("int")),
            lambda k: F.aggregate(F.slice(s["v"], k * s["b"] + 1, s["b"]), zero, add),
        )

    def spread(s):
        return F.transform(
            s["v"],
            lambda x, i: F.get(s["p"], F.floor(i / s["b"]).cast("int"))
            + F.aggregate(F.slice(s["v"], F.floor(i / s["b"]).cast("int") * s["b"] + 1, i % s["b"]), zero, add),
        )

    sized = F.struct(values.alias("v"), F.ceil(F.sqrt(F.size(values) + 1)).cast("int").alias("b"))
    summed = let(sized, lambda s: F.struct(s["v"].alias("v"), s["b"].alias("b"), blocks(s).alias("t")))
    offset = let(
        summed,
        lambda s: F.struct(
            s["v"].alias("v"),
            s["b"].alias("b"),
            F.transform(s["t"], lambda x, k: F.aggregate(F.slice(s["t"], 1, k), zero, add)).alias("p"),
        ),
    )
    return F.when(F.size(values) > 0, let(offset, spread)).otherwise(F.array().cast("array<bigint>"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` long pairs: rows ``(node, root)``, where
    the root is the smallest node of the component (the root's own row included).

    Alternating large-star and small-star rounds, each a group minimum and an equi-join; every
    round ends in a reliable checkpoint, and the loop stops when the edge set no longer changes. Only two
    numbers per round reach the driver. Self loops and repeated edges are allowed; no edges give
    no rows.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = (
            large.join(low, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
            .checkpoint()
        )
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
