"""Language identification with interpolated Kneser-Ney character models (operator 4).

Training: a bounded sample of labelled rows per language gives counts of 5-character grams (Spark sums them); the
lower orders use continuation counts. All languages share one sorted array of gram hashes per order; beside it stands a
matrix with each language's interpolated log probability and back-off weight. Prediction looks up the longest stored gram at
every position; the language with the lowest cross-entropy per character wins, and a text is rejected
(``accepted`` false) when even that lies above the language's calibrated limit.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import read_table, text_batches

ORDER = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_table: dict = {}


def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a space."""
    if "t" not in _table:
        _table["t"] = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    return _table["t"]


def normalise(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters; each run of other characters is one space, one more at either end."""
    codes = _letters()[np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le"), np.uint32)]
    return codes[(codes != 32) | (np.concatenate([[0], codes[:-1]]) != 32)]


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the grams of 1..order characters; item k-1 has those of k, by start position."""
    c = codes.astype(np.uint64) + np.uint64(1)  # along the first axis
    out = [c * _MIX]
    for k in range(2, order + 1):
        h = out[-1][: max(len(c) - k + 1, 0)]
        h = (h ^ (h >> np.uint64(29))) * _MIX + c[k - 1 :]
        out.append(h * _MIX)
    return out


def hash_each(grams: list[str], order: int) -> np.ndarray:
    """The hashes of separate grams of ``order`` characters."""
    if not grams or not order:
        return np.zeros(len(grams), np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, order)
    return gram_hashes(codes.T, order)[-1][0]


def _count_grams(batches):
    """Partial counts (lang, gram, n) of each Arrow batch, texts grouped by language."""
    for batch in batches:
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            codes = np.concatenate([normalise(t) for t in texts])
            if len(codes) < ORDER:
                continue
            _, first, n = np.unique(gram_hashes(codes, ORDER)[-1], return_index=True, return_counts=True)
            grams = [codes[i : i + ORDER].astype("<u4").tobytes().decode("utf-32-le") for i in first]
            inside = ["  " not in g for g in grams]  # two spaces: the seam of two texts
            grams, n = [g for g, ok in zip(grams, inside) if ok], n[inside]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n)], ["lang", "gram", "n"])


class Sorted:
    """A sorted hash array with an index by leading bits, so a search starts next to its place."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.start, append=len(keys)).max(initial=0))  # most keys with the same leading bits
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``wanted`` and whether the key there is the wanted one."""
        at = self.start.take((wanted >> self.shift).astype(np.int64))
        for _ in range(self.depth):
            at += self.keys.take(at) < wanted
        return at, (self.keys.take(at) == wanted) & (at < len(self.keys) - 1)


class Model:
    """Sorted hash arrays with one column of log probabilities and back-off weights per language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        self.limits = np.full(len(self.langs), np.inf)
        levels = [[counts[x] for x in self.langs]]  # order 5 first; then continuation counts
        for _ in range(ORDER - 1):
            lower = []
            for table in levels[-1]:
                seen: dict[str, int] = {}
                for gram in table:
                    seen[gram[1:]] = seen.get(gram[1:], 0) + 1
                lower.append(seen)
            levels.append(lower)
        levels.reverse()
        chars = len(set().union(*levels[0])) + 1
        self.keys, self.logp, self.back = [], [], []
        prob: list[dict] = []
        for k, tables in enumerate(levels):
            grams = sorted(set().union(*tables))
            new = np.empty((len(grams), len(self.langs)))
            weights: list[dict] = []
            for j, table in enumerate(tables):
                total: dict[str, int] = {}
                types: dict[str, int] = {}
                for gram, n in table.items():
                    total[gram[:-1]] = total.get(gram[:-1], 0) + n
                    types[gram[:-1]] = types.get(gram[:-1], 0) + 1
                once, two = (sum(n == m for n in table.values()) for m in (1, 2))
                d = min(max(once / (once + 2 * two), 0.1), 0.9) if once else 0.5
                weight = {h: d * types[h] / total[h] for h in total}
                weights.append(weight)
                for i, gram in enumerate(grams):
                    h = gram[:-1]
                    below = prob[-1].get(gram[1:], None) if k else None
                    p = (below[j] if below is not None else 1 / chars)
                    t = total.get(h)
                    new[i, j] = p if t is None else max(table.get(gram, 0) - d, 0) / t + weight[h] * p
            prob.append(dict(zip(grams, new)))
            keys = hash_each(grams, k + 1)
            order = np.argsort(keys)
            self.keys.append(Sorted(keys[order]))
            self.logp.append(np.log(new)[order].astype(np.float32))
            # back-off weights by context (of k characters): used when order k + 1 misses
            ctx = sorted(set().union(*weights))
            hashed = hash_each(ctx, k)
            order = np.argsort(hashed)
            rows = np.array([[w.get(h, 1.0) for w in weights] for h in ctx]).reshape(len(ctx), len(self.langs))
            self.back.append((Sorted(hashed[order]), np.log(np.maximum(rows, 1e-12))[order].astype(np.float32)))
        # a character that no language has seen gets an equal part of what is left over by order 1
        self.floor = np.log(1 / chars) + (self.back[0][1][0] if self.langs else 0)

    def cross_entropy(self, text: str | None, piece: int = 1 << 18) -> np.ndarray | None:
        """Nats per character under each language; None without a letter. Long texts go through in pieces."""
        codes = normalise(text)
        if not (codes != 32).any():
            return None
        total = np.zeros(len(self.langs))
        for at in range(0, len(codes), piece):
            total += self._sum(codes[max(at - ORDER + 1, 0) : at + piece], min(at, ORDER - 1))
        return total / len(codes)

    def _sum(self, codes: np.ndarray, skip: int) -> np.ndarray:
        """Summed negative log probability of the characters from ``skip`` on, each given those before."""
        grams = gram_hashes(codes, ORDER)
        total = np.zeros(len(self.langs))
        todo = np.arange(skip, len(codes))
        for k in range(ORDER, 0, -1):
            able = todo >= k - 1
            start = todo[able] - (k - 1)
            at, hit = self.keys[k - 1].find(grams[k - 1][start])
            total -= self.logp[k - 1].take(at[hit], 0).sum(0, dtype=np.float64)
            missed = start[~hit]
            if k > 1 and len(missed):
                ctx, rows = self.back[k - 1]
                b, known = ctx.find(grams[k - 2][missed])
                total -= rows[b[known]].sum(0, dtype=np.float64)
            todo = np.concatenate([todo[~able], missed + k - 1])
        return total - self.floor * len(todo)


def _sample(ids: DataFrame, rows: int, salt: str, where) -> DataFrame:
    """At most ``rows`` labelled rows per language, those with the smallest hashes; only ids and labels move, not texts.

    Counts per language and leading bits of the hash tell which of 1,024 bins are needed; rows are ranked inside a bin."""
    keyed = ids.filter(where).withColumn("_key", F.xxhash64(F.lit(salt), "doc_id", "text_hash")).withColumn("_bin", F.shiftright("_key", 54))
    earlier = Window.partitionBy("lang").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy("lang", "_bin").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    needed = bins.filter(F.col("_before") < rows).select("lang", "_bin", "_before")
    rank = F.row_number().over(Window.partitionBy("lang", "_bin").orderBy("_key", "doc_id", "text_hash"))
    near = keyed.join(needed, ["lang", "_bin"]).withColumn("_r", rank)
    return near.filter((F.col("_r") <= rows) & (F.col("_r") <= rows - F.col("_before"))).select("doc_id", "text_hash", "lang")


def train(
    docs: DataFrame,
    rows_per_lang: int = 2000,
    calibration_rows: int = 500,
    max_langs: int = 500,
    slack: float = 0.75,
) -> Model:
    """Fit on the labelled rows of ``docs`` (``doc_id, text, lang``).

    Bounds: per language ``rows_per_lang`` sampled documents are counted and ``calibration_rows`` others calibrate; more than ``max_langs``
    languages raise. All 5-grams of the sampled documents (whole texts) are counted and smoothed, and the lower orders' counts come from all of
    them; what reaches the driver and the tasks is bounded by the sample, not by the input.

    A language's limit is the 99 % quantile of its calibration texts' cross-entropy plus ``slack`` nats.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text_batches(docs.sparkSession)
    named = docs.filter("lang is not null and text is not null").select(
        "doc_id", "text", "lang", F.xxhash64("text").alias("text_hash")
    )
    ids = named.select("doc_id", "lang", "text_hash").dropDuplicates().checkpoint()  # the texts are hashed once
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text_hash"), F.lit(5))
    picks = (
        _sample(ids, rows_per_lang, "fit", part > 0).withColumn("use", F.lit("fit"))
        .unionByName(_sample(ids, calibration_rows, "calibrate", part == 0).withColumn("use", F.lit("calibrate")))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang"), "use")
        .checkpoint()
    )
    n = picks.agg(F.count_distinct("_lang")).first()[0]
    if n > max_langs:
        raise ValueError(f"{n} languages; raise max_langs")
    # broadcast: at most (rows_per_lang + calibration_rows) * n narrow rows
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("lang") == F.col("_lang"))
    texts = named.join(F.broadcast(picks), same).select("lang", "text", "use")
    grams = (
        texts.filter("use = 'fit'").select("lang", "text").mapInArrow(_count_grams, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, k in grams.select("lang", "gram", "n").toLocalIterator():
        counts.setdefault(lang, {})[gram] = k
    model = Model(counts)
    if counts:
        own = texts.filter("use = 'calibrate'").select("lang", _own_column(docs.sparkSession, model)("text", "lang").alias("h"))
        # no filter on h before the aggregate: it would be pushed below the join and score every document
        for lang, h in own.groupBy("lang").agg(F.percentile("h", F.lit(0.99))).collect():
            if lang in counts and h is not None:
                model.limits[model.langs.index(lang)] = h + slack
    return model


def _own_column(spark, model: Model):
    """Cross-entropy of a text under the model of its label."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def own(texts: pd.Series, langs: pd.Series) -> pd.Series:
        m = sent.value
        found = ((m.cross_entropy(t), x) for t, x in zip(texts, langs))
        return pd.Series([h[m.langs.index(x)] if h is not None and x in m.langs else None for h, x in found], dtype="float64")

    return own


def predict_column(spark, model: Model, sharpness: float = 20.0):
    """Arrow-batched column function: text -> struct ``lang, score, entropy, accepted``."""
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, entropy double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m, rows = sent.value, []
        for t in texts:
            h = m.cross_entropy(t) if m.langs else None
            if h is None:
                rows.append(("und", 0.0, None, False))
                continue
            best = int(h.argmin())
            score = 1 / np.exp(-(h - h[best]) * sharpness).sum()
            rows.append((m.langs[best], float(score), float(h[best]), bool(h[best] <= m.limits[best])))
        return pd.DataFrame(rows, columns=["lang", "score", "entropy", "accepted"])

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column: ``lang``, ``score`` (0 to 1), ``entropy`` (nats a character) and ``accepted``.

    ``lang`` is the learned value with the lowest cross-entropy (ties: the first in sorted order), also for rejected texts;
    ``und`` with score 0 if the text is null, empty or without a letter, or if nothing was learned. Rows are
    independent and texts are read whole; repeated rows get equal results; an empty table gives no
    rows; other columns pass through (one named like ``out`` is replaced).
    """
    return docs.withColumn(out, predict_column(docs.sparkSession, model)(docs[text_col]))


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))
    model = train(docs.filter(rest != 1))
    found = identify(docs.select("doc_id", "text", (rest == 1).alias("held_out")), model)
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.accepted").alias("accepted"),
    )
