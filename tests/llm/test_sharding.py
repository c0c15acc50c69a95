import math
from collections import Counter

import numpy as np
import zlib
from pyspark.sql import functions as F

from rankframe.llm import sharding as S


def test_hypergeometric_follows_its_law(spark):
    for n, k, m in ((50, 20, 10), (1000, 40, 300), (7, 7, 3), (9, 0, 4), (12, 5, 12), (2_000_000, 83_333, 31_250)):
        draws = spark.range(4000).select(
            S.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), S._uniform(F.lit(n), "id")).alias("x")
        ).collect()
        x = np.array([r.x for r in draws])
        lo, hi = max(0, m + k - n), min(m, k)
        assert lo <= x.min() and x.max() <= hi
        mean, var = m * k / n, m * (k / n) * (1 - k / n) * (n - m) / max(n - 1, 1)
        assert abs(x.mean() - mean) <= 5 * math.sqrt(var / len(x)) + 1e-9
        assert abs(x.var() - var) <= 0.15 * var + 1e-9
        if n == 50:
            p = [math.comb(k, i) * math.comb(n - k, m - i) / math.comb(n, m) for i in range(11)]
            seen = np.bincount(x, minlength=11) / len(x)
            assert np.abs(seen - p).max() < 0.03


def test_query(spark, sf):
    from rankframe.llm.suite import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    shards = Counter(r.shard for r in got)
    assert set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(shards[s]))
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    again = {r.doc_id: (r.shard, r.slot) for r in QUERIES["op7_sharding"](spark, sf).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_order_is_shuffled(spark):
    rows = spark.range(6000).withColumn("name", F.col("id").cast("string"))
    got = S.shuffle_into_shards(rows, ["id"], n_shards=6, partitions=8, chunks=4).collect()
    ids = np.array([r.id for r in sorted(got, key=lambda r: (r.shard, r.slot))])
    assert sorted(ids) == list(range(6000))
    assert abs(np.corrcoef(ids, np.arange(6000))[0, 1]) < 0.06
    assert abs(np.corrcoef(ids[:-1], ids[1:])[0, 1]) < 0.06
    assert len({r.name for r in got}) == 6000


def test_edges(spark, edge_docs, no_docs):
    got = S.shuffle_into_shards(edge_docs.withColumn("slot", F.lit("x")), ["doc_id", "text"], n_shards=5, partitions=3, chunks=2)
    assert got.count() == edge_docs.count() and got.columns.count("slot") == 1
    sizes = sorted(r[1] for r in got.groupBy("shard").count().collect())
    assert sizes[-1] - sizes[0] <= 1
    assert S.shuffle_into_shards(no_docs, ["doc_id"]).count() == 0
    equal = spark.range(100).select(F.lit(1).alias("k"))
    assert sorted(r["count"] for r in S.shuffle_into_shards(equal, ["k"], n_shards=8).groupBy("shard").count().collect()) == [12] * 4 + [13] * 4


def test_clashing_names_of_the_user_stay(spark):
    names = ("_key", "_part", "_place", "_chunk", "_before", "_n", "sent", "row", "k0", "part", "n")
    rows = spark.range(200).withColumns({c: F.lit("user") for c in names})
    got = S.shuffle_into_shards(rows, ["id", "_key"], n_shards=4, partitions=3, chunks=2)
    assert got.columns == [*rows.columns, "shard", "slot"]
    out = got.collect()
    assert sorted(r.id for r in out) == list(range(200)) and all(r[c] == "user" for r in out for c in names)
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in range(4) for i in range(50)]


def test_matrix_against_the_partitions_and_shards(spark):
    """Row sums are the partitions' sizes, column sums the shards' quotas, whatever the sizes."""
    sizes = [0, 1, 17, 300, 5, 1000, 2, 64]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part int, n long")
    for shards in (1, 5, 24):
        rows = {r.part: r.sent for r in S.communication_matrix(df, shards, 3).collect()}
        assert {p: sum(x) for p, x in rows.items()} == {i: n for i, n in enumerate(sizes) if n}
        total = sum(sizes)
        assert [sum(c) for c in zip(*rows.values())] == [total // shards + (k < total % shards) for k in range(shards)]
