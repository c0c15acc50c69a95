"""Uniform shuffle into shards of exact sizes (operator 7), in DataFrame functions only.

Rows fall into virtual partitions by hash. How many rows each partition sends to each shard is drawn from the
multivariate hypergeometric law, the law of those counts under a uniform permutation of all rows. Each partition
permutes its rows and cuts them by its row of the matrix; each shard permutes what it receives and numbers it. All
draws are hashes of keys and seed, so a task that is run again gives the same rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import let, read_table


def _uniform(*keys) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _steps(first: Column, last: Column, by: int) -> Column:
    ahead = first <= last if by > 0 else first >= last
    return F.when(ahead, F.sequence(first, last, F.lit(by).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(population: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """Number of marked among ``draws`` from ``population`` without replacement, by inversion.

    Probabilities relative to the mode's follow from their ratios, walked up and down from the mode; the walk
    ends ten standard deviations (and 30 values) away, beyond which no double-precision sum changes.
    """
    n_, k_, m_ = (x.cast("long") for x in (population, marked, draws))

    def bounded(s):
        n, k, m = s["n"], s["k"], s["m"]
        lo, hi = F.greatest(F.lit(0).cast("long"), m + k - n), F.least(m, k)
        mode = F.greatest(lo, F.least(hi, F.floor((m + 1) * ((k + 1) / (n + 2)))))
        spread = F.sqrt(F.greatest(F.lit(0.0), m * (k / n) * ((n - k) / n) * ((n - m) / F.greatest(n - 1, F.lit(1)))))
        width = F.ceil(spread * 10) + 30
        return F.struct(
            n.alias("n"), k.alias("k"), m.alias("m"), s["u"].alias("u"), mode.alias("mode"),
            _steps(mode + 1, F.least(hi, mode + width), 1).alias("up"),
            _steps(mode - 1, F.greatest(lo, mode - width), -1).alias("down"),
        )

    def walk(s, side):
        """Array-free walk: (weight, sum, picked value or null) along one side, from (1, offset, null)."""
        n, k, m = s["n"], s["k"], s["m"]
        if side == "up":
            return lambda w, x: w * ((k - x + 1) / x) * ((m - x + 1) / (n - k - m + x))
        return lambda w, x: w * ((x + 1) / (k - x)) * ((n - k - m + x + 1) / (m - x))

    def mass(s, side):
        ratio = walk(s, side)
        return F.aggregate(
            s[side],
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda a, x: let(ratio(a["w"], x), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))),
            lambda a: a["sum"],
        )

    def picked(s, t, side):
        """First value at which the running sum reaches ``t``; the last one if rounding leaves none."""
        ratio = walk(s, side)

        def step(a, x):
            w = F.when(a["sum"] >= t, a["w"]).otherwise(ratio(a["w"], x))
            return let(
                w,
                lambda w: F.struct(
                    w.alias("w"),
                    F.when(a["sum"] >= t, a["sum"]).otherwise(a["sum"] + w).alias("sum"),
                    F.when(a["sum"] >= t, a["x"]).otherwise(x).alias("x"),
                ),
            )

        begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), s["mode"].alias("x"))
        return F.aggregate(s[side], begin, step, lambda a: a["x"])

    def draw(s):
        return let(
            F.struct(mass(s, "up").alias("up"), mass(s, "down").alias("down")),
            lambda q: let(s["u"] * (1 + q["up"] + q["down"]), lambda t: F.when(t < 1, s["mode"])
                .when(t < 1 + q["up"], picked(s, t - 1, "up"))
                .otherwise(picked(s, t - 1 - q["up"], "down"))),
        )

    inputs = F.struct(n_.alias("n"), k_.alias("k"), m_.alias("m"), uniform.alias("u"))
    trivial = F.when((draws == 0) | (marked == 0), F.lit(0).cast("long")).when(marked == population, m_).when(draws == population, k_)
    return F.coalesce(trivial, let(inputs, lambda s: let(bounded(s), draw)))


def communication_matrix(sizes: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``part`` and ``sent`` (array: rows for each shard) from ``part, n``; shard sizes differ by one at most.

    One row holds the sizes of all partitions, a fixed number of them; partition after partition and shard after shard,
    each entry is drawn given those before.
    """
    zero = F.lit(0).cast("long")
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("total"))

    def row(left, p):
        def entry(s, k):
            u = _uniform(F.lit(seed), F.lit("matrix"), p["part"], k)
            return let(
                hypergeometric(s["pop"], F.get(left, k), s["need"], u),
                lambda x: F.struct(
                    (s["pop"] - F.get(left, k)).alias("pop"), (s["need"] - x).alias("need"), F.concat(s["row"], F.array(x)).alias("row")
                ),
            )

        begin = F.struct(
            F.aggregate(left, zero, lambda a, b: a + b).alias("pop"), p["n"].alias("need"), F.array().cast("array<bigint>").alias("row")
        )
        return F.aggregate(F.sequence(F.lit(0), F.lit(n_shards - 1)), begin, entry, lambda s: s["row"])

    def partition(s, p):
        return let(
            row(s["left"], p),
            lambda r: F.struct(
                F.zip_with(s["left"], r, lambda a, b: a - b).alias("left"),
                F.concat(s["out"], F.array(F.struct(p["part"].alias("part"), r.alias("sent")))).alias("out"),
            ),
        )

    quota = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda k: F.floor(F.col("total") / n_shards).cast("long") + (k < F.col("total") % n_shards).cast("long"),
    )
    begin = F.struct(quota.alias("left"), F.array().cast("array<struct<part:int,sent:array<bigint>>>").alias("out"))
    return one.select(F.inline(F.aggregate("parts", begin, partition, lambda s: s["out"])))


def permuted(df: DataFrame, group: str, key: Column, out: str, tie: list[str], chunks: int) -> DataFrame:
    """Add the 0-based place of each row in the order of ``key`` (long hash) inside its ``group``, gapless.

    Groups are cut into ``chunks`` ranges of the key, so one group's rows are spread over many tasks; the rows before a
    range come from the table of counts, which has at most groups times ``chunks`` rows.
    """
    keyed = df.withColumn("_key", key).withColumn("_chunk", F.floor(F.shiftrightunsigned("_key", 1) / F.lit(2.0**63) * chunks).cast("int"))
    counts = keyed.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy("_key", *tie)) - 1
    ranked = keyed.withColumn(out, place).join(F.broadcast(offsets), [group, "_chunk"])
    return ranked.withColumn(out, F.col(out) + F.col("_before")).drop("_key", "_chunk", "_before")


def shuffle_into_shards(
    rows: DataFrame, keys: list[str], n_shards: int = 24, partitions: int = 64, chunks: int = 64, seed: int = 7
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); shard sizes differ by one at most.

    ``keys`` identify a row; rows with equal keys (nulls included) are interchangeable and are spread by their
    place among the others. All columns of ``rows`` travel, so pass narrow rows and join wide ones later. ``shard`` and
    ``slot`` of the input are replaced. An empty table gives no rows. The place in a partition depends on keys and seed alone.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    kept = rows.drop("shard", "slot")
    # the user's columns travel in one struct, so no name of theirs meets one of the columns made here
    keyed = [f"k{i}" for i in range(len(keys))]
    boxed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), *[F.col(k).alias(a) for k, a in zip(keys, keyed)])
    hashed = lambda what: F.xxhash64(F.lit(seed), F.lit(what), *[F.col(k) for k in keyed])
    base = boxed.withColumn("_part", F.pmod(hashed("part"), F.lit(partitions)).cast("int")).checkpoint()
    sizes = base.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(sizes, n_shards, seed).withColumnRenamed("part", "_part")  # at most ``partitions`` rows
    placed = permuted(base, "_part", hashed("first"), "_place", keyed, chunks).join(F.broadcast(matrix), "_part")
    cut = F.aggregate(
        "sent",
        F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("sum")),
        lambda s, n: F.struct((s["shard"] + (s["sum"] + n <= F.col("_place")).cast("int")).alias("shard"), (s["sum"] + n).alias("sum")),
        lambda s: s["shard"],
    )
    sent = placed.select("row", cut.alias("shard"), "_part", "_place").checkpoint()
    second = F.xxhash64(F.lit(seed), F.lit("second"), "_part", "_place")
    numbered = permuted(sent, "shard", second, "slot", ["_part", "_place"], chunks)
    return numbered.select("row.*", "shard", F.col("slot").cast("long").alias("slot"))


def op7_sharding(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
