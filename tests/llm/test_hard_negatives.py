import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_mine(rows, is_anchor, n_pos=5, n_neg=3, low=50, high=95):
    """The contract over all pairs; rows are (id, vector, label)."""
    by_id = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in by_id or (str(label), v) < (str(by_id[i][1]), by_id[i][0]):
            by_id[i] = (v, label)
    q = {i: ([math.floor(256 * x) for x in v], label) for i, (v, label) in by_id.items()}
    out = set()
    for a, (qa, la) in q.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, qb)), b, lb == la) for b, (qb, lb) in q.items() if b != a)
        for minus, p, _ in [s for s in scored if s[2]][:n_pos]:
            fit = [(-s, b) for s, b, same in scored if not same and low * -minus <= -100 * s <= high * -minus]
            out |= {(a, p, r, b, -minus, s) for r, (s, b) in enumerate(fit[:n_neg], 1)}
    return out


def rows_of(vectors, labels):
    return [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, labels))]


def random_rows(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    labels = r.choice([0, 0, 0, 1, 2, 3], n)
    centres = r.normal(size=(4, dim))
    v = centres[labels] + spread * r.normal(size=(n, dim))
    return rows_of(v / np.linalg.norm(v, axis=1, keepdims=True) * r.choice([1, 1, 2, 0.1], (n, 1)), labels)


@pytest.mark.parametrize("seed,dim,spread", [(1, 8, 0.2), (2, 16, 3.0), (3, 2, 0.6)])
def test_equals_all_pairs(spark, seed, dim, spread):
    rows = random_rows(seed, 400, dim, spread)
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.mine(df, anchor=F.col("vec_id") % 3 == 0, block_rows=50, anchor_rows=20)
    assert {tuple(r) for r in got.collect()} == plain_mine(rows, lambda i: i % 3 == 0)


def test_parameters_change_the_work_only(spark):
    rows = random_rows(4, 150, 6, 0.8)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_mine(rows, lambda i: True, 2, 4, -30, 99)
    for refs, block in ((1, 7), (12, 1000)):
        got = H.mine(df, n_positives=2, n_negatives=4, low_percent=-30, high_percent=99, n_references=refs, block_rows=block, anchor_rows=block, sample_rows=20)
        found = got.collect()
        assert len(found) == len(set(found)) and {tuple(r) for r in found} == want


def test_ties_repeats_and_odd_rows(spark):
    same = [(i, [1.0, 0.5], 0) for i in range(60)] + [(i, [0.5, 0.4], 1) for i in range(60, 130)]
    odd = [
        (None, [1.0, 1.0], 0), (200, None, 0), (201, [1.0, None], 0), (202, [float("nan"), 1.0], 1), (203, [1.0, float("inf")], 1), (204, [1.0, 1.0], None),
        (205, [], 0), (206, [0.0, 0.0], 1), (207, [-1.0, -1.0], 0), (208, [-1.0], 1), (209, [1.0, 0.5, 0.25], 0), (3, [1.0, 0.5], 0), (4, [9.0, 9.0], 1), (210, [1e300, 0.0], 0),
    ]
    rows = same + odd
    got = H.mine(spark.createDataFrame(rows, SCHEMA), block_rows=16, anchor_rows=16).collect()
    padded = [(i, v if v is None or len(v) >= 3 else v + [0.0] * (3 - len(v)), c) for i, v, c in rows if i != 210]
    # floor(256 * 0) is 0, so padding by zeros is what the missing components count as
    assert {tuple(r) for r in got} == plain_mine(padded, lambda i: True)


def test_large_norms_stay_exact(spark):
    r = np.random.default_rng(7)
    rows = rows_of(r.uniform(-4.8e6, 4.8e6, size=(80, 3)), r.integers(0, 3, 80))
    beyond = [(500, [9e6, 0.0, 0.0], 0), (501, [4.9e6] * 3, 1)]
    got = H.mine(spark.createDataFrame(rows + beyond, SCHEMA))
    assert {tuple(x) for x in got.collect()} == plain_mine(rows, lambda i: True)


def test_bounds_hold_and_save_work():
    r = np.random.default_rng(5)
    q = np.floor(256 * r.normal(size=(300, 12)) * r.choice([1, 20, 0], (300, 1)))
    q[50:60] = q[0]
    q[60] = -q[0]
    refs, _ = H.references(q, [str(i % 3) for i in range(300)], 6)
    norms = np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip(q @ refs.T / np.maximum(norms, 1e-300)[:, None], -1, 1))
    row = {"a_n": 300, "a_ids": np.arange(300, dtype="<i8").tobytes(), "a_q": q.astype("<i4").tobytes(), "a_norms": norms.tobytes(), "a_angles": angles.tobytes()}
    b = H._Block(row, "a")
    low, high = H.score_bounds(b, b, slice(0, 300))
    exact = q @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    # one reference along the vectors' own direction leaves hardly any room
    tight = H._Block(row | {"a_angles": np.arccos(np.clip(q @ q[:1].T / np.maximum(norms * norms[0], 1e-300)[:, None], -1, 1)).tobytes()}, "a")
    low, high = H.score_bounds(tight, tight, slice(0, 1))
    assert ((high - low) <= 1e-5 * norms[0] * norms + 2).all()


def test_block_pairs_out_of_reach_are_left_out(spark):
    """Tight clusters: the blocks of a far cluster cannot hold a score inside the windows, so they meet nobody."""
    r = np.random.default_rng(8)
    v = np.concatenate([[1, 0, 0] + 0.01 * r.normal(size=(40, 3)), [0.8, 0.6, 0] + 0.01 * r.normal(size=(40, 3)), [-1, 0, 0] + 0.01 * r.normal(size=(40, 3))])
    rows = rows_of(v, np.repeat([0, 1, 2], 40))
    made = []
    meets = H._meets
    try:
        H._meets = lambda low, high: made.append(1) or meets(low, high)
        got = H.mine(spark.createDataFrame(rows, SCHEMA))
    finally:
        H._meets = meets
    assert {tuple(x) for x in got.collect()} == plain_mine(rows, lambda i: True) and made
    d = lambda x: F.array(*[F.lit(float(y)) for y in x])
    row = lambda a, x: spark.range(1).select(
        *[d(a).alias(f"a_{s}_angles") for s in ("low", "high")], *[d(x).alias(f"x_{s}_angles") for s in ("low", "high")],
        *[F.lit(1e4).alias(f"{side}_{s}_norm") for side in "ax" for s in ("low", "high")],
    )
    inside = lambda a, x, lo, hi: row(a, x).select(meets(F.lit(lo), F.lit(hi)).alias("m")).first().m
    assert not inside([0.0], [3.1], 10, 10**8) and inside([0.0], [3.1], -(10**8), 0)
    assert inside([0.5], [1.0], 5e7, 6e7) and not inside([0.5], [1.0], 9e7, 1e8)


def test_edges(spark):
    clash = spark.createDataFrame(random_rows(6, 40, 4, 0.5), SCHEMA).withColumns({c: F.lit("user") for c in ("id", "v", "anchor", "block", "q", "norm", "score", "row_id")})
    want = plain_mine([(r.vec_id, r.embedding, r.label) for r in clash.collect()], lambda i: True)
    assert {tuple(r) for r in H.mine(clash).collect()} == want
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert H.mine(empty).count() == 0
    assert H.mine(clash, anchor=F.lit(False)).count() == 0
    assert H.mine(clash.withColumn("label", F.lit(1))).count() == 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert before == "10000" or int(before) >= 1000


def test_query(spark, sf):
    from rankframe.llm.suite import QUERIES

    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op13_hard_negatives"](spark, sf).collect()
    assert {tuple(r) for r in got} == plain_mine(rows, lambda i: i % 50 == 0) and got
