"""File sources and sinks (S1-S5, S10-S12): declared schemas, no inference."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, tokenize
from ..operators.ranking import RUN_COLUMNS


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').option("mode", "FAILFAST").csv(path)
    )


def read_documents_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV ``id_right,text_right`` -> (doc_id, text); texts may hold quotes/newlines."""
    return _csv(spark, path, "id_right string, text_right string").select(
        F.col("id_right").alias("doc_id"), F.col("text_right").alias("text"))


def read_queries_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV ``id_left,text_left`` -> (query_id, text)."""
    return _csv(spark, path, "id_left string, text_left string").select(
        F.col("id_left").alias("query_id"), F.col("text_left").alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """S3: headerless TSV ``query_id unused doc_id relevance`` -> (query_id, doc_id, relevance INT)."""
    raw = spark.read.schema("query_id string, unused string, doc_id string, relevance int").option("sep", "\t").option("mode", "FAILFAST").csv(path)
    return raw.select("query_id", "doc_id", "relevance")


def parse_trec_lines(lines: DataFrame, run_name: str | None = None, rank_offset: int = 1, col: str = "value") -> DataFrame:
    """Any-whitespace separated run lines; the file rank is 0-based and gets ``rank_offset``
    (use 0 for runs written by ``write_trec_run``, which are already 1-based)."""
    t = tokenize(F.col(col))
    df = lines.select(t.alias("_t")).filter(F.size("_t") > 0).select(
        F.col("_t")[0].alias("query_id"), F.col("_t")[1].alias("Q0"), F.col("_t")[2].alias("doc_id"),
        (F.col("_t")[3].cast("int") + F.lit(rank_offset)).alias("rank"), F.col("_t")[4].cast("double").alias("score"),
        F.col("_t")[5].alias("run_name"),
    )
    return df.withColumn("run_name", F.lit(run_name)) if run_name is not None else df


def read_trec_run(spark: SparkSession, path: str, run_name: str | None = None, rank_offset: int = 1) -> DataFrame:
    return parse_trec_lines(spark.read.text(path), run_name, rank_offset)


def trec_lines(run: DataFrame) -> DataFrame:
    """S10 formatting: ``query_id Q0 doc_id rank score run_name`` per row."""
    return run.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in RUN_COLUMNS]).alias("value"))


def write_trec_run(run: DataFrame, path: str) -> None:
    """Space-separated, no header, six columns."""
    trec_lines(run).write.mode("overwrite").text(path)


def write_runs_csv(runs: DataFrame, path: str) -> None:
    """Header CSV, one folder per run."""
    runs.select(*RUN_COLUMNS).write.mode("overwrite").partitionBy("run_name").option("header", True).csv(path)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, stripped, blanks skipped, distinct."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).filter(F.col("word") != "").distinct()


def write_json_record(df: DataFrame, path: str) -> None:
    """S12 sink: a one-row aggregate as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def check_contract(df: DataFrame, required: list[str], unique: str | None = None) -> None:
    """Required columns exist, no nulls in them, ``unique`` has no repeats; raise naming the column.

    One aggregate over the table (count_if(isnull) per column, count - count(distinct))."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"table lacks {missing}")
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    if unique:
        aggs.append((F.count(F.lit(1)) - F.countDistinct(unique)).alias("dup"))
    row = df.agg(*aggs).first()
    bad = [c for c in required if row[f"null_{c}"]]
    if bad:
        raise ValueError(f"nulls in {bad}")
    if unique and row["dup"]:
        raise ValueError(f"{unique} is not unique")


def write_checked(df: DataFrame, path: str, required: list[str], unique: str | None = None, fail: bool = True) -> DataFrame:
    """Write ``df`` to ``path`` (parquet, replaced) and check its contract by the job that writes it.

    Row and null counts are metrics that the writing job observes, so they cost no pass of their own; repeats of ``unique`` are counted afterwards
    from that one column of the written table, partial counts first. Returns ``column, n_rows, n_null, n_repeated`` (null for
    columns that need not be unique). A column that is missing raises before anything is written; nulls or repeats raise with the
    columns named unless ``fail`` is false, and leave the written table for inspection."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"table lacks {missing}")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(required)]).write.mode("overwrite").parquet(path)
    metrics = seen.get
    spark = df.sparkSession
    repeated = None
    if unique is not None:
        sizes = spark.read.schema(df.schema).parquet(path).filter(F.col(unique).isNotNull()).groupBy(unique).agg(F.count(F.lit(1)).alias("n"))
        repeated = sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    nulls = {c: metrics[f"null_{i}"] for i, c in enumerate(required)}
    bad = [f"nulls in {c}" for c, n in nulls.items() if n] + ([f"{unique} is not unique"] if repeated else [])
    if fail and bad:
        raise ValueError("; ".join(bad))
    rows = [(c, metrics["rows"], nulls[c], repeated if c == unique else None) for c in required]
    return spark.createDataFrame(rows, "column string, n_rows long, n_null long, n_repeated long")
