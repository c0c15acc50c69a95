"""Leakage-free splits (C5, C6): deterministic md5-seeded orders instead of Python RNG streams."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded_key
from ..plans.ordinals import global_ordinal


def query_split(df: DataFrame, key: str = "query_id", share: float = 0.1, seed: int = 42,
                out: str = "split", names: tuple[str, str] = ("train", "vali")) -> DataFrame:
    """Choose ``floor(share * n)`` distinct keys (ordered by md5(seed:key)) as the second
    split; every row of a key goes with it."""
    keys = df.select(F.col(key).cast("string").alias("_rf_key")).distinct()
    n = keys.count()
    k = int(n * share)
    ranked = global_ordinal(keys.withColumn("_rf_h", seeded_key(seed, F.col("_rf_key"))), ["_rf_h", "_rf_key"], out="_rf_o")
    chosen = ranked.filter(F.col("_rf_o") <= k).select("_rf_key", F.lit(names[1]).alias(out))
    return (
        df.withColumn("_rf_key", F.col(key).cast("string"))
        .join(F.broadcast(chosen) if k <= 1_000_000 else chosen, "_rf_key", "left")
        .withColumn(out, F.coalesce(F.col(out), F.lit(names[0])))
        .drop("_rf_key")
    )


def grouped_split(
    df: DataFrame,
    group_col: str,
    stratum_col: str,
    test_size: float = 0.1,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Grouped, stratified train/test split.

    Groups never straddle the split. Each group belongs to its main stratum (most rows, ties by
    name). A stratum's groups, largest first (ties by md5(seed:group)), are dealt to and fro over
    ``round(1 / test_size)`` folds, so fold sizes differ by at most the largest group; the fold
    nearest to ``test_size`` of the stratum's rows is the test side, unless none at all is nearer
    (a stratum of very few groups). Groups are numbered by a range-partitioned order and only
    (stratum, fold) totals are ranked, so a stratum with a third of all groups is one more range.
    """
    folds = max(round(1 / test_size), 1)
    g = df.groupBy(group_col, stratum_col).agg(F.count(F.lit(1)).alias("_n"))
    main = g.groupBy(group_col).agg(
        F.min_by(stratum_col, F.struct(-F.col("_n"), F.col(stratum_col))).alias("_stratum"), F.sum("_n").alias("_size")
    )
    order = main.withColumn("_neg", -F.col("_size")).withColumn("_h", seeded_key(seed, F.col(group_col)))
    ranked = global_ordinal(order, ["_stratum", "_neg", "_h", group_col], out="_o")
    first = ranked.groupBy(F.col("_stratum").alias("_key")).agg(F.min("_o").alias("_first"), F.sum("_size").alias("_total"))
    at = F.col("_o") - F.col("_first")
    way = F.pmod(at, F.lit(2 * folds))
    dealt = ranked.join(first, F.col("_stratum").eqNullSafe(F.col("_key"))).select(
        group_col, "_stratum", "_size", "_total", F.when(way < folds, way).otherwise(2 * folds - 1 - way).alias("_fold")
    )
    off = F.round(F.abs(F.sum("_size") - F.first("_total") * F.lit(float(test_size))), 6)
    sums = dealt.groupBy("_stratum", "_fold").agg(
        off.alias("_off"), F.sum("_size").alias("_rows"), F.round(F.first("_total") * F.lit(float(test_size)), 6).alias("_goal")
    )
    best = sums.groupBy("_stratum").agg(F.min_by(F.struct("_fold", "_off", "_goal"), F.struct("_off", -F.col("_rows"), "_fold")).alias("_b"))
    chosen = best.filter("_b._off <= _b._goal").select(F.col("_stratum").alias("_s"), F.col("_b._fold").alias("_f"))
    assigned = dealt.join(chosen, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_fold") == F.col("_f")), "left").select(
        group_col, F.when(F.col("_f").isNotNull(), F.lit("test")).otherwise(F.lit("train")).alias(out)
    )
    return df.join(assigned, group_col)


def split_metadata(split_df: DataFrame, source: str, test_size: float, seed: int, out: str = "split") -> DataFrame:
    """One-row record (source, test_size, seed, n_train, n_test)."""
    return split_df.agg(
        F.lit(source).alias("source"),
        F.lit(float(test_size)).alias("test_size"),
        F.lit(int(seed)).alias("random_state"),
        F.count_if(F.col(out) == "train").alias("num_train"),
        F.count_if(F.col(out) == "test").alias("num_test"),
    )
