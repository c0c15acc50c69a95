"""The rows of a learning-to-rank evaluation are scored once, whatever the number of its parts."""
from pyspark.sql import functions as F

from rankframe.operators import ltr


def test_rows_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = spark.createDataFrame([(g, r, float((g + r) % 3), r * 7 % 5) for g in range(4) for r in range(6)], "group_id int, row_id int, label double, x int")
    found = ltr.ltr_metrics(rows.withColumn("score", counted("x")), k=3).first()
    assert seen.value == rows.count()
    assert 0 < found["NDCG@3"] <= 1 and 0 < found["Precision@3"] <= 1


def test_gradient_rows_are_parsed_once(spark, monkeypatch):
    from rankframe.suite import queries as Q

    kind, written = type(spark.range(1)), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: written.append(self.columns) or plain(self, *a, **k))
    plan = Q.ltr_ndcg_gradients(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert ["g", "r", "y", "s"] in written and "parquet" not in plan
