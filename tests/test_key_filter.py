from pyspark.sql import functions as F

from rankframe.plans.key_filter import BUCKET, MAX_BYTES, filter_words, key_filter, may_match


def test_no_key_is_lost_and_few_others_pass(spark):
    n = 50_000
    keys = spark.range(n).select(F.xxhash64("id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    size = filter_words(n)
    made = key_filter(keys, "k", size)
    assert made.count() * BUCKET == size and made.filter(F.size("words") != BUCKET).count() == 0
    probe = spark.range(4 * n).select("id", F.xxhash64("id").alias("k"))
    left = may_match(probe.unionByName(spark.createDataFrame([(-1, None)], "id long, k long")), F.col("k"), made, size)
    assert left.columns == ["id", "k"] and left.filter("id < 0").count() == 0
    assert left.filter(F.col("id") < n).count() == n
    assert left.filter(F.col("id") >= n).count() < 0.002 * 3 * n
    small = filter_words(1)  # far too small for the keys: weaker, still whole
    assert may_match(probe.filter(F.col("id") < n), F.col("k"), key_filter(keys, "k", small), small).count() == n


def test_size_is_bounded_and_empty_tables_work(spark):
    assert filter_words(0) == BUCKET and filter_words(10**12) * 8 == MAX_BYTES
    none = spark.createDataFrame([], "k long")
    made = key_filter(none, "k", filter_words(0))
    assert made.count() == 1
    assert may_match(spark.range(100).select(F.col("id").alias("k")), F.col("k"), made, filter_words(0)).count() == 0
    assert may_match(none, F.col("k"), made, filter_words(0)).count() == 0


def test_rows_are_not_shuffled(spark):
    size = filter_words(10)
    rows = spark.range(1000).select(F.col("id").alias("k"))
    plan = may_match(rows, F.col("k"), key_filter(rows.filter("k < 10"), "k", size), size)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
