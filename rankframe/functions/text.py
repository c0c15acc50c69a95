"""Column functions for text: tokeniser, strip, pooled-document text and ids.

Everything here returns a ``Column`` built from Spark built-ins, so it runs inside
whole-stage code generation and needs no Python worker.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's ``str.isspace`` is true, i.e. the
# separators of ``str.split()`` with no argument. The same class works in Java regex and RE2.
WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
WHITESPACE_RUN = WHITESPACE_CLASS + "+"
# The same characters as a plain string (for ``trim``): ranges 0x1C-0x1F and 0x2000-0x200A spelled out.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text: Column | str) -> Column:
    """Whitespace tokens like ``str.split()``: no empty tokens, case and punctuation kept.

    ``array_remove`` (not a lambda ``filter``) keeps the expression inside generated code.
    """
    return F.array_remove(F.split(_c(text), WHITESPACE_RUN), "")


def explode_tokens(tokens: Column | str) -> Column:
    """``explode_outer`` of a token array; callers drop the null row of an empty array.

    Plain ``explode`` makes Catalyst infer ``size(tokens) > 0`` and push it under the
    exchange that balances the input, which tokenises every document a second time inside the
    scan task. The outer form infers nothing.
    """
    return F.explode_outer(_c(tokens))


def strip(text: Column | str) -> Column:
    """``str.strip()``: drop Unicode whitespace at both ends (plain ``trim`` only drops spaces;
    ``trim`` with the character set is a linear scan, no regex)."""
    return F.trim(_c(text), F.lit(WHITESPACE_CHARS))


def combine_title_and_chunk(title: Column | str, chunk: Column | str) -> Column:
    """Pooled document text: ``title. chunk`` unless the chunk already starts with the title.

    Null parts count as empty; an empty chunk gives an empty text (dropped by callers).
    """
    t = strip(F.coalesce(_c(title), F.lit("")))
    c = strip(F.coalesce(_c(chunk), F.lit("")))
    return (
        F.when(c == "", F.lit(""))
        .when((t != "") & ~c.startswith(t), F.concat(t, F.lit(". "), c))
        .otherwise(c)
    )


# Fixed value: id prefix of pooled documents.
POOL_DOC_PREFIX = "mirage_"


def pool_doc_id(title: Column | str, chunk: Column | str, prefix: str = POOL_DOC_PREFIX) -> Column:
    """Content-addressed id: prefix + md5 of the combined UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(combine_title_and_chunk(title, chunk)))


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


def runs_of(ordered: Column, same, made) -> Column:
    """``made(array, first, length)`` for each run of neighbours of a sorted array that are the ``same`` (1-based ``first``); null for an empty array."""

    def cut(s):
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | ~same(F.get(s, i - 1), F.get(s, i)))
        first = lambda e, j: F.coalesce(F.get(e, j - 1), F.lit(0)) + 1
        return _let(ends, lambda e: F.transform(e, lambda end, j: made(s, first(e, j), end - first(e, j) + 1)))

    return F.when(F.size(ordered) > 0, _let(ordered, cut))


def term_counts(tokens: Column | str) -> Column:
    """array<struct<term, tf>> of a token array, by run lengths of its sorted tokens (null for no tokens): a row counts its own
    terms, without a shuffle."""
    return runs_of(F.sort_array(_c(tokens)), lambda a, b: a == b, lambda s, i, n: F.struct(F.get(s, i - 1).alias("term"), n.cast("long").alias("tf")))


def term_places(tokens: Column | str) -> Column:
    """array<struct<word, places>> of a token array: each distinct word with the 0-based places where it stands (null for no tokens)."""
    placed = F.sort_array(F.transform(_c(tokens), lambda t, i: F.struct(t.alias("word"), i.alias("at"))))
    return runs_of(
        placed, lambda a, b: a["word"] == b["word"],
        lambda s, i, n: F.struct(F.get(s, i - 1)["word"].alias("word"), F.slice(s, i, n)["at"].alias("places")),
    )


def bigrams(tokens: Column | str) -> Column:
    """Adjacent pairs ``w1_w2`` of a token array (no shuffle, no ``lead``)."""
    t = _c(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit("_"), b))


def token_pairs(tokens: Column | str) -> Column:
    """Adjacent pairs as ``struct(w1, w2)`` (used where both words need a lookup)."""
    t = _c(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))


def seeded_key(seed: int | str, key: Column | str) -> Column:
    """Deterministic pseudo-random order key: ``md5(seed ':' key)`` (same in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))
