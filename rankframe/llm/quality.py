"""Quality rules by compression bands (operator 6).

The zstandard ratio (UTF-8 bytes over compressed bytes) of the whole text and of its fixed chunks must lie in a band that
depends on the length: repetitive text compresses too well, random text too little.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, text_batches

# Characters that count as white space and as symbols.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Bands (bytes up to, lowest ratio, highest ratio). A frame has a few bytes of overhead, so very short
# texts have no lower limit to speak of; long texts share more substrings and compress better. The lowest ratios lie just under
# those of the given clean texts and chunks (e.g. 1.81 up to 4,096 bytes, 2.00 up to 16,384, 2.19 beyond).
BANDS = (
    (64, 0.40, 3.5), (128, 0.90, 3.5), (256, 1.10, 3.5), (512, 1.19, 5.0), (1024, 1.45, 5.0), (2048, 1.55, 6.0), (4096, 1.75, 6.0),
    (16384, 1.90, 7.0), (1 << 62, 2.10, 8.0),
)
CHUNK = 4096
# A document fails by its chunks if over this share of its bytes lies in chunks out of band.
CHUNK_SHARE = 0.1

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, n_bad_bytes long"
)


def repeat_words(words: list, width: int = 8) -> int:
    """Words inside ``width``-word windows that occur twice or more (``width`` a power of two).

    Windows get exact class numbers by doubling: equal pairs of equal halves. No hashing is involved.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    step = 1
    while step < width:
        ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)[1]
        step *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def in_band(size: int, packed: int, bands=BANDS) -> bool:
    _, low, high = next(b for b in bands if size <= b[0])
    return low <= size / packed <= high


def measure(text: str | None, pack, chunk: int = CHUNK, bands=BANDS) -> tuple:
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    whole = len(pack(raw))
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
    bad = [len(x) for x in parts if not in_band(len(x), len(pack(x)), bands)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(raw) / whole,
        len(parts),
        len(bad),
        sum(bad),
    )


def measures(chunk: int = CHUNK, level: int = 1, bands=BANDS):
    """Arrow-batched column function: text -> struct of ``RESULT``."""

    @F.pandas_udf(RESULT)
    def measured(texts: pd.Series) -> pd.DataFrame:
        pack = zstandard.ZstdCompressor(level=level).compress
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pd.DataFrame([measure(t, pack, chunk, bands) for t in texts], columns=names)

    return measured


def quality(docs: DataFrame, text_col: str = "text", chunk: int = CHUNK, level: int = 1, bands=BANDS) -> DataFrame:
    """``docs`` with a struct column ``quality``: the counts, the ratio, ``base_failed`` and ``kept``.

    Null and empty texts have zero words and fail the base rules. Whole texts are measured, whatever their length.
    Rows are independent: no shuffle, repeated rows get equal results, an empty table gives no rows, other columns
    pass through (one named ``quality`` is replaced).
    """
    text_batches(docs.sparkSession)
    q = measures(chunk, level, bands)(docs[text_col])
    out = docs.withColumn("quality", q)
    size = F.octet_length(F.coalesce(out[text_col], F.lit("")))
    x = lambda name: F.col(f"quality.{name}")
    base = (x("n_words") < 20) | (100 * x("n_repeat_words") > 30 * x("n_words"))
    low, high = F.lit(bands[-1][1]), F.lit(bands[-1][2])
    for top, a, b in reversed(bands[:-1]):
        low, high = F.when(size <= top, a).otherwise(low), F.when(size <= top, b).otherwise(high)
    banded = x("ratio").between(low, high) & (x("n_bad_bytes") <= CHUNK_SHARE * size)
    return out.withColumn(
        "quality", F.col("quality").withField("base_failed", base).withField("kept", ~base & banded)
    )


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    docs = quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept ratio".split()
    return docs.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])
