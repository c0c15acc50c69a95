"""Global numbering and prefix sums without a single-partition window.

``row_number().over(Window.orderBy(..))`` moves every row into one task. At scale that is one
executor holding the whole table, so the two helpers here split the work:

* ``global_ordinal`` range-partitions on the sort key, numbers rows inside each partition with
  ``monotonically_increasing_id`` after a local sort (no extra exchange), and adds the sizes of
  all earlier partitions (a table with one row per partition). The numbered partitions are
  materialised once with a reliable ``checkpoint()`` (shared checkpoint folder): the sizes and
  the rows must come from the same partitioning, and a recomputed range partitioning (other
  sample, other bounds) would not be; it also cuts the lineage for executor loss.
* ``prefix_sums`` cuts an already-numbered table into fixed-size buckets, takes running sums per
  bucket and adds the totals of earlier buckets (one row per bucket).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PID, _LOCAL, _OFF, _N = "_rf_pid", "_rf_local", "_rf_off", "_rf_n"


def global_ordinal(
    df: DataFrame,
    order: Sequence[Column | str],
    out: str = "ordinal",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 1-based contiguous row number in ``order`` (which must be a total order)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    local = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn(_PID, F.spark_partition_id())
        # within a partition the id counts rows from 0 in sorted order; the partition index
        # sits in the upper bits
        .withColumn(_LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
        .checkpoint(eager=True)
    )
    sizes = local.groupBy(_PID).agg(F.count(F.lit(1)).alias(_N))
    # one row per partition: an unpartitioned window over it is harmless
    offsets = sizes.select(
        _PID,
        F.coalesce(
            F.sum(_N).over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias(_OFF),
    )
    return (
        local.join(F.broadcast(offsets), _PID)
        .withColumn(out, F.col(_OFF) + F.col(_LOCAL) + 1)
        .drop(_PID, _LOCAL, _OFF)
    )


def prefix_sums(
    df: DataFrame,
    ordinal: str,
    values: dict[str, Column | str],
    bucket_size: int = 100_000,
) -> DataFrame:
    """Running sums (inclusive) of ``values`` in ``ordinal`` order, bucketed.

    ``values`` maps output name -> column to sum. ``ordinal`` must be unique per row.
    """
    b = "_rf_bucket"
    base = df.withColumn(b, F.floor((F.col(ordinal) - 1) / F.lit(bucket_size)))
    for name, col in values.items():
        base = base.withColumn(f"_rf_v_{name}", F.col(col) if isinstance(col, str) else col)
    w = Window.partitionBy(b).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    local = base
    for name in values:
        local = local.withColumn(f"_rf_s_{name}", F.sum(f"_rf_v_{name}").over(w))
    totals = base.groupBy(b).agg(*[F.sum(f"_rf_v_{name}").alias(f"_rf_t_{name}") for name in values])
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        b, *[F.coalesce(F.sum(f"_rf_t_{name}").over(before), F.lit(0)).alias(f"_rf_o_{name}") for name in values]
    )
    out = local.join(F.broadcast(offsets), b)
    for name in values:
        out = out.withColumn(name, F.col(f"_rf_o_{name}") + F.col(f"_rf_s_{name}"))
    drop = [b] + [f"_rf_{k}_{name}" for name in values for k in ("v", "s", "o")]
    return out.drop(*drop)


def keyed_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "ordinal",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 1-based contiguous row number inside each key, in ``order`` (a total order inside a key), without a window.

    Rows are range-partitioned on key and order together, so a key with a third of all rows is split over many partitions;
    its first global number (an aggregate with partial minima, one row per key) turns global numbers into its own. Null keys count as equal.
    """
    g, first, kept = "_rf_g", "_rf_first", [f"_rf_key{i}" for i in range(len(keys))]
    numbered = global_ordinal(df, [*[F.col(k) for k in keys], *order], out=g, num_partitions=num_partitions)
    firsts = numbered.groupBy(*keys).agg(F.min(g).alias(first)).select(*[F.col(k).alias(a) for k, a in zip(keys, kept)], first)
    same = F.lit(True)
    for k, a in zip(keys, kept):
        same = same & F.col(k).eqNullSafe(F.col(a))
    return numbered.join(firsts, same).withColumn(out, F.col(g) - F.col(first) + 1).drop(g, first, *kept)
