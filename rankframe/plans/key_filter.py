"""A Bloom filter on long keys as a small table, to drop rows without a partner before a shuffle join.

The filter is a bit array of 64-bit words, cut into buckets of ``BUCKET`` words: one row per bucket, so it is built by grouped
``bit_or`` and met by an equi-join on the bucket number. All bits of a key lie in one word, so a test reads one word.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 1024  # words in a bucket (8 KiB)
BITS = 4  # bits that a key sets in its word
BITS_PER_KEY = 32
MAX_BYTES = 64 << 20


def filter_words(n_keys: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BYTES) -> int:
    """Words of a filter for ``n_keys`` keys, a multiple of ``BUCKET``: ``bits_per_key`` bits each, within ``max_bytes``."""
    buckets = -(-max(n_keys, 1) * bits_per_key // (64 * BUCKET))
    return BUCKET * max(1, min(buckets, max_bytes // (8 * BUCKET)))


def _word(key: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words).cast("long"))


def _bits(key: Column) -> Column:
    h, out = F.xxhash64(key, F.lit(1)), None
    for i in range(BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def key_filter(keys: DataFrame, key_col: str, n_words: int) -> DataFrame:
    """Rows ``(bucket, words)`` for the non-null keys: ``n_words / BUCKET`` rows, whatever the number of keys.

    ``n_words`` comes from ``filter_words``. More keys than it was made for let more rows through and lose none. Empty words stand as
    zeros, so a list of ``BUCKET`` words is never longer or shorter."""
    key = keys[key_col]
    held = keys.filter(key.isNotNull()).select(_word(key, n_words).alias("word"), _bits(key).alias("bits"))
    zeros = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = held.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"]
    return words.groupBy(F.expr(f"word div {BUCKET}").alias("bucket")).agg(listed.alias("words"))


def may_match(df: DataFrame, key: Column, made: DataFrame, n_words: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be one of the filter's: all that are, and few others. Null keys go.

    The filter has at most ``MAX_BYTES`` bytes by ``filter_words`` and is broadcast; ``df`` is not shuffled."""
    made = made.select(F.col("bucket").alias("_filter_bucket"), F.col("words").alias("_filter_words"))
    word, bits = _word(key, n_words), _bits(key)
    same = F.expr("_filter_bucket") == F.call_function("div", word, F.lit(BUCKET).cast("long"))
    place = F.pmod(word, F.lit(BUCKET).cast("long")).cast("int")
    hit = F.get(F.col("_filter_words"), place).bitwiseAND(bits) == bits
    return df.filter(key.isNotNull()).join(F.broadcast(made), same & hit, "left_semi")
