import random
import re

import numpy as np
import xxhash

from rankframe.llm import simhash as H
from rankframe.llm.common import connected_components


def brute_fingerprint(text, k=3):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    """Smallest index linked to each, comparing all pairs."""
    low = list(range(len(fps)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_matches_brute_force(spark, sf):
    from rankframe.llm.suite import QUERIES

    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in texts]
    classes = [texts[i][0] for i in brute_classes(fps)]
    got = sorted(QUERIES["op2_simhash_near_dedup"](spark, sf).collect())
    assert [tuple(r) for r in got] == [(d, f"{f:016x}", c) for (d, _), f, c in zip(texts, fps, classes)]
    assert any(c != d for (d, _), c in zip(texts, classes))


def _clustered(seed, n):
    rng, out = random.Random(seed), set()
    while len(out) < n:
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 60])):
            out.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                at ^= 1 << b
    return sorted(out)


def _signed(fps):
    return [H._signed(f) for f in fps]


def test_links_connect_all_and_only_close_pairs(spark):
    fps = _clustered(3, 700)
    want = brute_classes(fps)
    for bucket_rows in (4096, 3):  # the second sends nearly all buckets through the finer keys
        df = spark.createDataFrame([(f,) for f in _signed(fps)], "fp long")
        edges = H.links(df, 3, bucket_rows)
        near = {f: i for i, f in enumerate(_signed(fps))}
        cc = {r.node: r.root for r in connected_components(edges).collect()}
        got: dict = {}
        for f, i in near.items():
            got.setdefault(cc.get(f, f), []).append(i)
        assert sorted(map(tuple, map(sorted, got.values()))) == sorted(
            {tuple(j for j in range(len(fps)) if want[j] == r) for r in set(want)}
        )


def test_masks_are_exhaustive():
    rng = np.random.default_rng(1)
    for mask in H.block_masks(3):
        assert all(m & mask == 0 for m in H.finer_masks(mask, 3))
        assert max(64 - (m | mask).bit_count() for m in H.finer_masks(mask, 3)) <= 15
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        shared = [m for m in H.block_masks(3) if m & diff == 0]
        assert shared and all(any(f & diff == 0 for f in H.finer_masks(m, 3)) for m in shared)


def test_edges(spark, edge_docs, no_docs):
    got = H.near_duplicates(edge_docs).collect()
    texts = edge_docs.collect()
    assert sorted(H._signed(brute_fingerprint(r.text)) for r in texts) == sorted(r.fp for r in got)
    zero = [r for r in got if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {0}
    kept = H.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    classes = {r.root for r in got}
    assert kept.count() == len(classes)
    assert H.near_duplicates(no_docs).count() == H.keep_one(no_docs).count() == 0


def test_batch_bounds_keep_lower_settings(spark):
    from rankframe.llm.common import text_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("256m", "16m"), ("1g", "16m"), ("300000", "300000"), ("2m", "2m")):
            spark.conf.set(name, given)
            text_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 100), (7, 7), (200, 201), (-5, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, -5: -5, 200: -5, 201: -5}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_leaves_the_users_columns(spark):
    from pyspark.sql import functions as F

    names = ("_id", "_hash", "_n", "id", "hash", "n", "root", "fp")
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z u v w q")], "doc_id long, text string").withColumns({n: F.lit("user") for n in names})
    from rankframe.llm import simhash

    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, *[r[n] for n in names]) for r in left.collect()) == [(1, *["user"] * len(names)), (3, *["user"] * len(names))]
