"""URL filters by rules and a character language-model ratio (operator 3), in DataFrame functions only.

URLs that a rule accepts and URLs that a rule rejects train one Markov model each over host and path: the
probability of a character after its context is smoothed with that of the next shorter context, down to the uniform one.
A URL without a rule is scored by the mean, over its characters, of the log likelihood ratio under the longest known context
(variable order) and compared with a limit calibrated on ruled URLs that did not train.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import free_names, let, read_table

# The rules (verdict, host and subdomains, start of the path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER, TAU, FOLDS, BINS = 5, 4.0, 5, 400
UNIT = 10**9  # log ratios are summed as whole numbers of 1 / UNIT, so sums do not depend on the order of rows
SALTS = 32  # copies of each gram of one or two characters in a join by gram


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null for none); ties go to the rule given first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _gram(chars: Column, end: Column, k: int) -> Column:
    """The ``k`` characters that end at 0-based ``end``; null where there are fewer."""
    return F.when(end >= k - 1, F.array_join(F.slice(chars, end - (k - 2), k), ""))


def train(labelled: DataFrame, order: int = ORDER, tau: float = TAU) -> DataFrame:
    """Rows ``gram, ratio``: every gram of up to ``order`` characters and the log ratio of its probabilities, in ``1 / UNIT``.

    ``labelled`` has ``text`` and ``verdict``. All its rows are counted; the table grows with the number of different grams.
    """
    ensure_checkpoint_dir(labelled.sparkSession)
    ends = let(
        _chars(F.col("text")),
        lambda c: F.flatten(
            F.transform(
                F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>")),
                lambda i: F.array(*[_gram(c, i, k) for k in range(1, order + 1)]),
            )
        ),
    )
    counts = (
        labelled.select("verdict", F.explode(ends).alias("gram"))
        .filter("gram is not null")
        .groupBy("gram")
        .agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
        .withColumn("k", F.length("gram"))
        .checkpoint()
    )
    after = Window.partitionBy(F.expr("left(gram, k - 1)"))  # at most as many rows as there are characters
    levels, below = [], None
    for k in range(1, order + 1):
        level = counts.filter(F.col("k") == k).withColumns({"na": F.sum("a").over(after), "nb": F.sum("b").over(after)})
        if below is None:
            level = level.withColumns({"qa": F.lit(1 / 256), "qb": F.lit(1 / 256)})
        else:
            shorter = below.select(F.col("gram").alias("_s"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            level = level.join(shorter, F.expr("substring(gram, 2)") == F.col("_s"))
        smooth = lambda n, total, q: (F.col(n) + tau * F.col(q)) / (F.col(total) + tau)
        below = level.select(
            "gram", smooth("a", "na", "qa").alias("pa"), smooth("b", "nb", "qb").alias("pb")
        ).checkpoint()
        levels.append(below)
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    return grams.select("gram", F.round(F.log(F.col("pa") / F.col("pb")) * UNIT).cast("long").alias("ratio")).checkpoint()


def _window_ratios(positions: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """Rows ``_w, n, ratio`` for each different window of ``positions`` that has a known gram at its end: occurrences, ratio of the longest."""
    suffixes = F.array_compact(F.array(*[F.when(F.length("_w") >= k, F.right("_w", F.lit(k))) for k in range(1, order + 1)]))
    tried = positions.groupBy("_w").agg(F.count("*").alias("n")).select("_w", "n", F.explode(suffixes).alias("gram"))
    # many windows end in the same one or two characters
    short = F.length("gram") <= 2
    tried = tried.withColumn("_salt", F.when(short, F.pmod(F.xxhash64("_w"), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = model.select("gram", "ratio", F.explode(copies).alias("_salt"))
    found = tried.join(known, ["gram", "_salt"])
    return found.groupBy("_w").agg(F.first("n").alias("n"), F.max_by("ratio", F.length("gram")).alias("ratio"))


def scored(df: DataFrame, text: Column, model: DataFrame, order: int = ORDER, broadcast_rows: int = 200_000) -> DataFrame:
    """``df`` with ``score``: mean log likelihood ratio (accepted over rejected) per character; 0 for an empty text.

    Each different text is scored once. The windows of its positions (up to ``order`` characters) meet the grams once per different
    window; up to ``broadcast_rows`` windows are broadcast to the positions (if there are more, the commonest), others join by key.
    """
    ensure_checkpoint_dir(df.sparkSession)
    own = free_names(df.columns, "text")[0]
    every = df.drop("score").withColumn(own, text)

    def windows(c):
        start = lambda i: F.greatest(F.lit(1), i - (order - 2))
        return F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.array_join(F.slice(c, start(i), i + 2 - start(i)), ""))

    texts = every.select(F.col(own).alias("_text")).filter(F.length("_text") > 0).distinct()
    positions = texts.select("_text", F.explode(let(_chars(F.col("_text")), windows)).alias("_w"))
    ratios = _window_ratios(positions, model, order).checkpoint()
    rows, total = ratios.agg(F.count("*"), F.sum("n")).first()
    if rows <= broadcast_rows:
        found = positions.join(F.broadcast(ratios), "_w")
    else:
        # at most ``broadcast_rows`` windows are above this share
        often = F.col("n") * broadcast_rows > total
        common, rare = ratios.filter(often), ratios.filter(~often)
        found = positions.join(F.broadcast(common), "_w")
        rest = positions.join(F.broadcast(common.select("_w")), "_w", "left_anti")
        found = found.unionByName(rest.join(rare, "_w"))
    # written, so that a join with an often repeated text can be split
    scores = found.groupBy("_text").agg((F.sum("ratio") / UNIT / F.length("_text")).alias("score")).checkpoint()
    return every.join(scores.withColumnRenamed("_text", own), own, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).select(*df.drop("score").columns, "score")


def calibrate(ruled: DataFrame) -> DataFrame:
    """One row ``cut``: the limit on the scores with the best balanced accuracy on ``score, verdict`` (no labels: null)."""
    bins = (
        ruled.groupBy(F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") * 100))).alias("bin"))
        .agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    )
    # at most 2 * BINS + 1 rows
    upward, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    kept = 1 - F.try_divide(F.coalesce(F.sum("a").over(upward), F.lit(0)), F.sum("a").over(whole))
    caught = F.try_divide(F.coalesce(F.sum("b").over(upward), F.lit(0)), F.sum("b").over(whole))
    best = bins.select("bin", F.round(kept + caught, 9).alias("gain"))
    return best.filter("gain is not null").agg((F.max_by("bin", F.struct("gain", -F.col("bin"))) / 100).alias("cut"))


def judge(
    pages: DataFrame, url_col: str = "url", rules=RULES, order: int = ORDER, tau: float = TAU, folds: int = FOLDS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (the rule's, else allow from the limit up).

    Null URLs and URLs without ``://`` have an empty host and path, no rule and score 0; they are judged like others.
    With no ruled URL of either kind nothing is learned: scores and limit are 0, so the rest is allowed. Repeated rows
    count as often as they occur and get equal results; an empty table gives no rows; other columns pass through (those
    named like the new ones are replaced). One fold of the URLs (by hash) calibrates, the others train.
    """
    ensure_checkpoint_dir(pages.sparkSession)

    def judged(df):
        host, path = parts(df[url_col])
        df = df.withColumns({"host": host, "path": path})
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return df.withColumns({"rule": rule, "verdict": verdict})

    text = F.concat("host", "path")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(folds))
    ruled = judged(pages.select(url_col)).filter("verdict is not null").select(text.alias("text"), "verdict")
    model = train(ruled.filter(fold > 0), order, tau)
    limit = calibrate(scored(ruled.filter(fold == 0), F.col("text"), model, order))
    out = scored(judged(pages.drop("host", "path", "rule", "score", "verdict")), text, model, order)
    passes = F.col("score") >= F.coalesce(limit.scalar(), F.lit(0.0))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(passes, "allow").otherwise("block")))


def op3_url_filters(spark, sf_dir) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
