"""Fill-in-middle transformation by counted-quantifier patterns (operator 11).

A text is cut into units of a regular expression. ``regexp_count`` gives their number n; two draws from a keyed hash
choose the cuts a <= b; a pattern made for the row, with possessive groups ``unit{a}`` and ``unit{b-a}``, captures prefix,
middle and suffix in one match, and its replacement is the marked output. Possessive groups never give a unit back, so a
match walks the text once and keeps no stack, however long the text is.

No shuffle, no Python: each row depends on its text and id alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, read_table

LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight hex digits of the SHA-256 of ``seed:key``, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def _quoted(mark: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in mark)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = LINES,
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    marks: tuple[str, str, str] = MARKS,
    out: str = "fim",
) -> DataFrame:
    """``docs`` with the struct ``out``: ``n`` (long), ``form``, ``output``, ``prefix_chars`` and ``middle_chars`` (long).

    ``unit`` is a Java pattern without capturing groups whose matches, left to right, cover every text. ``form`` is ``plain``
    for an empty text (null counts as empty, n = 0), a text that holds one of the three ``marks`` (prefix, suffix, middle) and
    all but ``percent`` in a hundred; else ``spm`` (suffix first) for ``spm_percent`` in a hundred and ``psm`` (prefix first).
    The output of a plain row is its text, and its two lengths (code points) are null. Draws depend on the id and the seed
    (a null id draws as an empty string), so repeated rows get equal results. An empty table gives no rows. Other columns pass
    through whatever their names; one named like ``out`` is replaced.
    """
    key, text = docs[id_col], F.coalesce(docs[text_col], F.lit(""))
    t, n, a, b, form, made = free_names([*docs.columns, out], "t", "n", "a", "b", "form", "made")
    pre, suf, mid = marks
    h1, h2, h3, h4 = draws(key, seed)
    counted = docs.withColumn(t, text).withColumn(n, F.regexp_count(t, F.lit(f"(?:{unit})")).cast("long"))
    cuts = (h1 % (F.col(n) + 1), h2 % (F.col(n) + 1))
    marked = F.contains(t, F.lit(pre)) | F.contains(t, F.lit(suf)) | F.contains(t, F.lit(mid))
    kind = F.when((F.col(t) == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    chosen = counted.withColumns({a: F.least(*cuts), b: F.greatest(*cuts), form: kind})
    some = lambda k: F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit("(?s)\\A"), some(F.col(a)), some(F.col(b) - F.col(a)), F.lit("(.*+)\\z"))
    escaped = [m.replace("\\", "\\\\").replace("$", "\\$") for m in marks]
    order = F.when(F.col(form) == "psm", "{0}$1{1}$3{2}$2".format(*escaped)).otherwise("{1}$3{0}$1{2}$2".format(*escaped))
    output = F.when(F.col(form) == "plain", F.col(t)).otherwise(F.regexp_replace(t, pattern, order))
    cut = chosen.withColumn(made, output)
    at = lambda mark: F.locate(mark, F.col(made))
    # the middle is last in both forms; the prefix ends before the suffix mark or the middle mark
    prefix = F.when(F.col(form) == "psm", at(suf) - 1 - len(pre)).otherwise(at(mid) - at(pre) - len(pre))
    middle = F.length(made) - at(mid) + 1 - len(mid)
    length = lambda c: F.when(F.col(form) != "plain", c.cast("long"))
    result = F.struct(
        F.col(n).alias("n"), F.col(form).alias("form"), F.col(made).alias("output"),
        length(prefix).alias("prefix_chars"), length(middle).alias("middle_chars"),
    )
    return cut.select(*[docs[c] for c in docs.columns if c.lower() != out.lower()], result.alias(out))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output, rebuilt from it and its form alone. Each mark occurs once in a text that was cut, so it parts it."""
    pre, suf, mid = map(_quoted, marks)
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{pre}(.*?){suf}(.*?){mid}(.*+)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{suf}(.*?){pre}(.*?){mid}(.*+)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir) -> DataFrame:
    cut = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        sha(F.col("fim.output")).alias("output_sha256"),
        sha(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


# The twin cuts with list functions instead of patterns: units are the lines of split() with their line feed put back.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h,
         string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
u AS (
  SELECT doc_id, t, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4,
         CAST(len(s) - CASE WHEN s[len(s)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n,
         list_transform(range(1, len(s) + 1), lambda i: s[i] || CASE WHEN i < len(s) THEN chr(10) ELSE '' END) AS units FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
         array_to_string(units[b + 1:], '') AS suf FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                 ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
