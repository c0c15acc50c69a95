"""Secret scans by patterns and sliding-window entropy (operator 1), in DataFrame functions only.

Patterns give the base spans. Outside them, candidate strings of each character class are walked with a window of fixed
width: the window keeps one count per character of the class, and a step changes two counts and the sum of c * log2(c),
from which the Shannon entropy follows. Windows at or above the class's limit are
merged into spans; candidates on the allow-list are left out.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums, read_table

# The base patterns; (kind, pattern, group whose length counts, its least length).
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the maximal runs of 16 and more
)


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class: their pattern, alphabet, window, entropy limit (bits) and a pattern each must have."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    limit: float
    needs: str


CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{16,}", "0123456789abcdefABCDEF", 16, 2.7, r"^(?=.*[0-9])(?=.*[A-Fa-f])"),
    CharClass(
        "entropy_base64",
        r"[A-Za-z0-9+/_=-]{20,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        20,
        3.8,
        r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])",
    ),
)
# Stretches that are no secrets (examples, UUIDs, counting and repeated characters); windows that overlap one do not count.
ALLOWED = (
    r"(?i)example|sample|dummy|changeme|placeholder",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|1234567890",
    r"([A-Za-z0-9])\1{7}",
)
SPAN = "struct<start:bigint,no:int,end:bigint>"
MASK = "[SECRET]"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _located(text: Column, pattern: str, values: Column) -> Column:
    """Array of (text, start, end, value) of the leftmost non-overlapping matches; positions in code points.

    The pieces between the matches and the matches themselves alternate, so starts are prefix sums of their lengths.
    """
    both = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        values.alias("values"),
    )

    def starts(s):
        steps = F.transform(s["found"], lambda m, i: (F.get(s["gaps"], i) + F.length(m)).cast("long"))
        return let(
            F.struct(s["gaps"].alias("gaps"), s["found"].alias("found"), s["values"].alias("values"), prefix_sums(steps).alias("p")),
            rows,
        )

    def rows(s):
        def row(m, i):
            start = F.get(s["p"], i) + F.get(s["gaps"], i)
            return F.struct(
                m.alias("text"), start.alias("start"), (start + F.length(m)).alias("end"), F.get(s["values"], i).alias("value")
            )

        return F.transform(s["found"], row)

    return let(both, starts)


def _pattern_spans(text: Column, no: int) -> Column:
    _, pattern, group, least = KINDS[no]
    found = _located(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    kept = F.transform(
        F.filter(found, lambda m: F.length(m["value"]) >= least),
        lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("no"), m["end"].alias("end")),
    )
    return F.when(text.rlike(pattern), kept).otherwise(_none())


def _blanked(text: Column, no: int) -> Column:
    """``text`` with the matches of kind ``no`` overwritten by as many spaces."""
    _, pattern, group, least = KINDS[no]
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def rebuilt(s):
        def piece(gap, i):
            m = F.get(s["found"], i)
            blank = F.when(F.length(F.get(s["values"], i)) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m)
            return F.concat(gap, F.coalesce(blank, F.lit("")))

        return F.array_join(F.transform(s["gaps"], piece), "")

    return F.when(text.rlike(pattern), let(parts, rebuilt)).otherwise(text)


def _high_windows(candidate: Column, c: CharClass, allowed: Column) -> Column:
    """Merged windows of high entropy inside one candidate: array of (a, b), offsets in it. Windows that overlap one of the ``allowed`` stretches
    (array of structs with ``start`` and ``end``) do not count.

    The counts live in a string, one character per member of the alphabet, its code 32 above the count.
    """
    w, alphabet = c.window, F.lit(c.alphabet)
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)])
    blank = F.lit(" " * len(c.alphabet))

    def count(counts, at):
        return F.ascii(F.substring(counts, at, F.lit(1))) - 32

    def put(counts, at, n):
        return F.overlay(counts, F.char(n + 32), at, 1)

    def walk(chars, length):
        def leave(s, i):
            at = F.instr(alphabet, F.get(chars, i - w))
            return let(
                F.struct(at.alias("at"), count(s["counts"], at).alias("n")),
                lambda x: F.struct(
                    put(s["counts"], x["at"], x["n"] - 1).alias("counts"),
                    (s["sum"] + F.get(weight, x["n"] - 1) - F.get(weight, x["n"])).alias("sum"),
                ),
            )

        def enter(s, i):
            at = F.instr(alphabet, F.get(chars, i))
            return let(
                F.struct(at.alias("at"), count(s["counts"], at).alias("n")),
                lambda x: F.struct(
                    put(s["counts"], x["at"], x["n"] + 1).alias("counts"),
                    (s["sum"] + F.get(weight, x["n"] + 1) - F.get(weight, x["n"])).alias("sum"),
                ),
            )

        def step(s, i):
            window = F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"))
            fresh = let(F.when(i >= w, leave(s, i)).otherwise(window), lambda x: enter(x, i))
            return let(fresh, lambda x: merge(s, x, i))

        def merge(s, x, i):
            first = i - w + 1
            high = (i >= w - 1) & (F.lit(math.log2(w)) - x["sum"] / w >= c.limit)
            high = high & ~F.exists(allowed, lambda m: (m["start"] <= i) & (m["end"] > first))
            apart = high & (first > s["b"])
            run = F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))
            return F.struct(
                x["counts"].alias("counts"),
                x["sum"].alias("sum"),
                F.when(apart & (s["b"] >= 0), F.concat(s["runs"], run)).otherwise(s["runs"]).alias("runs"),
                F.when(apart, first).otherwise(s["a"]).alias("a"),
                F.when(high, i + 1).otherwise(s["b"]).alias("b"),
            )

        begin = F.struct(
            blank.alias("counts"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<a:int,b:int>>").alias("runs"),
            F.lit(-1).alias("a"), F.lit(-1).alias("b"),
        )
        done = lambda s: F.when(
            s["b"] >= 0, F.concat(s["runs"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))
        ).otherwise(s["runs"])
        return F.aggregate(F.sequence(F.lit(0), length - 1), begin, step, done)

    return let(F.split(candidate, "", -1), lambda chars: walk(chars, F.length(candidate)))


def _entropy_spans(text: Column, c: CharClass, no: int, allowed: tuple[str, ...]) -> Column:
    found = F.filter(_located(text, c.pattern, F.array().cast("array<string>")), lambda m: m["text"].rlike(c.needs))
    stretches = lambda m: F.array().cast("array<struct<start:bigint,end:bigint>>")
    if allowed:
        known = "|".join(f"(?:{p})" for p in allowed)

        def stretches(m):
            where = F.transform(_located(m["text"], known, F.array().cast("array<string>")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
            return F.when(m["text"].rlike(known), where).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))

    spans = F.flatten(
        F.transform(
            found,
            lambda m: F.transform(
                let(stretches(m), lambda known: _high_windows(m["text"], c, known)),
                lambda r: F.struct((m["start"] + r["a"]).alias("start"), F.lit(no).alias("no"), (m["start"] + r["b"]).alias("end")),
            ),
        )
    )
    return F.when(text.rlike(c.pattern), spans).otherwise(_none())


def scan(
    docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, no, end), sorted; ``no`` counts the kinds in
    the order of ``KINDS``, then ``classes``; positions in code points, end exclusive.

    Null text counts as empty (no spans). Whole texts are scanned, of any length; rows are independent (no shuffle), so
    repeated rows get equal spans; an empty table gives no rows; other columns pass through (those
    named like the new ones are replaced).
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.withColumn("base_spans", F.sort_array(F.concat(*[_pattern_spans(text, no) for no in range(len(KINDS))])))
    blank_kind = lambda no: lambda t: _blanked(t, no)
    blank = text
    for no in range(len(KINDS)):
        blank = let(blank, blank_kind(no))
    # bound as a variable: every class reads the blanked text
    more = let(
        F.when(F.size("base_spans") > 0, blank).otherwise(text),
        lambda t: F.concat(*[_entropy_spans(t, c, len(KINDS) + i, allowed) for i, c in enumerate(classes)]),
    )
    return base.withColumn("spans", F.sort_array(F.concat("base_spans", more)))


def span_text(spans: Column, classes: tuple[CharClass, ...] = CLASSES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], *[F.lit(c.kind) for c in classes])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(scanned: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``scanned`` with every span in ``text_col`` replaced by ``mask`` (overlapping or touching spans by one); null stays null."""
    spans = F.col("spans")

    def merge(out, s):
        last = F.element_at(out, -1)
        longer = F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["end"]).alias("b"))),
        )
        fresh = F.concat(out, F.array(F.struct(s["start"].alias("a"), s["end"].alias("b"))))
        return F.when(F.size(out) == 0, fresh).when(F.try_element_at(out, F.lit(-1))["b"] >= s["start"], longer).otherwise(fresh)

    runs = F.aggregate(spans, F.array().cast("array<struct<a:bigint,b:bigint>>"), merge)

    def rebuilt(s):
        def piece(r, i):
            begin = F.coalesce(F.get(s["runs"], i - 1)["b"], F.lit(0).cast("long"))
            return F.concat(F.array_join(F.slice(s["chars"], begin + 1, r["a"] - begin), ""), F.lit(mask))

        tail = F.coalesce(F.element_at(s["runs"], -1)["b"], F.lit(0).cast("long"))
        rest = F.array_join(F.slice(s["chars"], tail + 1, F.size(s["chars"])), "")
        return F.concat(F.array_join(F.transform(s["runs"], piece), ""), rest)

    parts = F.struct(runs.alias("runs"), F.regexp_extract_all(text_col, F.lit("(?s)."), F.lit(0)).alias("chars"))
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, let(parts, rebuilt)).otherwise(scanned[text_col]))


def op1_secret_scans(spark, sf_dir) -> DataFrame:
    docs = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda no: F.size(F.filter("base_spans", lambda s: s["no"] == no)).cast("long")
    return docs.select(
        "doc_id",
        *[count(no).alias(f"n_{kind[0]}") for no, kind in enumerate(KINDS)],
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
