"""A seeded permutation of ``0 .. n-1`` as a column expression: no sort, no exchange.

A position is written as a pair ``(left, right)`` in ``[0, a) x [0, b)`` with ``a * b >= n``. Each round adds a keyed function of one half to the
other half modulo its size, which can be undone, so the rounds permute the pairs. Positions that land on ``n`` or beyond are permuted
again until they do not (cycle walking): as ``a * b - n < a``, about one in ``sqrt(n)`` does. The arithmetic is plain 64-bit
integer arithmetic, the same in SQL.
"""
from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, WALK = 6, 24
MODULUS = (1 << 31) - 1  # products of two numbers below it fit 63 bits


def halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Two multipliers and a summand below ``MODULUS`` for each round, from the MD5 of seed and round."""
    keys = []
    for i in range(ROUNDS):
        digest = hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
        keys.append(tuple(int(digest[j : j + 8], 16) % (MODULUS - 1) + 1 for j in (0, 8, 16)))
    return keys


def _mixed(x, key, size, floor_div):
    """A number below ``size`` from the half ``x``: two multiplications, between which the high bits come down."""
    m1, m2, c = key
    y = (x % MODULUS + c) % MODULUS * m1 % MODULUS
    return (y + floor_div(y, 32768)) % MODULUS * m2 % MODULUS % size


def permuted_int(p: int, n: int, seed: int) -> int:
    """The permutation in plain Python."""
    a, b = halves(n)
    while True:
        left, right = p // b, p % b
        for i, key in enumerate(round_keys(seed)):
            if i % 2:
                right = (right + _mixed(left, key, b, lambda x, y: x // y)) % b
            else:
                left = (left + _mixed(right, key, a, lambda x, y: x // y)) % a
        p = left * b + right
        if p < n:
            return p


def _div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y).cast("long"))


def _scaled(x: Column, key) -> Column:
    m1, _, c = key
    return (x % MODULUS + F.lit(c).cast("long")) % MODULUS * F.lit(m1).cast("long") % MODULUS


def _shift(y: Column, key, size: int) -> Column:
    return (y + _div(y, 32768)) % MODULUS * F.lit(key[1]).cast("long") % MODULUS % F.lit(size).cast("long")


def _once(p: Column, a: int, b: int, keys) -> Column:
    """One pass over all rounds inside a single expression: halves are bound by lambda variables, so it grows with the rounds only."""
    let = lambda value, body: F.transform(F.array(value), body)[0]
    pair = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    s = pair(_div(p, b), p % F.lit(b).cast("long"))
    for i, key in enumerate(keys):
        if i % 2:
            s = let(s, lambda s: let(_scaled(s["l"], key), lambda y: pair(s["l"], (s["r"] + _shift(y, key, b)) % F.lit(b).cast("long"))))
        else:
            s = let(s, lambda s: let(_scaled(s["r"], key), lambda y: pair((s["l"] + _shift(y, key, a)) % F.lit(a).cast("long"), s["r"])))
    return let(s, lambda s: s["l"] * b + s["r"])


def with_permuted(df: DataFrame, position: str, n: int, seed: int, out: str) -> DataFrame:
    """``df`` with ``out``: where the 0-based ``position`` (below ``n``) goes. The rounds are plain projections inside generated code; only the
    few positions that land on ``n`` or beyond walk on. Raises if a walk does not end in ``WALK`` steps (odds of about ``n ** -12``)."""
    a, b = halves(n)
    keys = round_keys(seed)
    left, right, y, p = "_rf_left", "_rf_right", "_rf_y", "_rf_p"
    at = df.withColumns({left: _div(F.col(position).cast("long"), b), right: F.col(position).cast("long") % F.lit(b).cast("long")})
    for i, key in enumerate(keys):
        moved, other, size = (right, left, b) if i % 2 else (left, right, a)
        at = at.withColumn(y, _scaled(F.col(other), key)).withColumn(moved, (F.col(moved) + _shift(F.col(y), key, size)) % F.lit(size).cast("long"))
    at = at.withColumn(p, F.col(left) * b + F.col(right))
    far = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), F.col(p), lambda v, _: F.when(v < n, v).otherwise(_once(v, a, b, keys)))
    settled = F.when(F.col(p) < n, F.col(p)).otherwise(far)
    checked = F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("the permutation did not settle")).cast("long"))
    return at.withColumn(out, settled).withColumn(out, checked).drop(left, right, y, p)


def permuted_sql(position: str, n: str, a: str, b: str, seed: int) -> str:
    """The same permutation in DuckDB SQL; ``n``, ``a`` and ``b`` are SQL expressions."""

    def mixed(x, key, size):
        m1, m2, c = key
        y = f"((({x} % {MODULUS} + {c}) % {MODULUS}) * {m1} % {MODULUS})"
        return f"((({y} + {y} // 32768) % {MODULUS}) * {m2} % {MODULUS} % {size})"

    def once(p):
        step = f"{{'l': {p} // {b}, 'r': {p} % {b}}}"
        for i, key in enumerate(round_keys(seed)):
            s = f"s{i}"
            new = f"{{'l': {s}.l, 'r': ({s}.r + {mixed(s + '.l', key, b)}) % {b}}}" if i % 2 else f"{{'l': ({s}.l + {mixed(s + '.r', key, a)}) % {a}, 'r': {s}.r}}"
            step = f"list_transform([{step}], lambda {s}: {new})[1]"
        return f"list_transform([{step}], lambda z: z.l * {b} + z.r)[1]"

    start = once(position)
    return f"list_reduce(list_concat([{start}], range(2, {WALK + 1})), lambda p, x: CASE WHEN p < {n} THEN p ELSE {once('p')} END)"
