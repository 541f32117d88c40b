"""Inputs at the edge: lines of JSON, JSON objects as maps, result folders by tag, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: The record of an inference run.
INFERENCE = "idx int, sid long, generated_raw string, generated string, gen_status string, gen_flags array<string>, engine string"


def json_lines(spark: SparkSession, path: str, schema: str = INFERENCE) -> DataFrame:
    """Records of a file or folder of lines of JSON; blank lines are none, fields that are missing are null."""
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def json_line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row, n: the number of lines that are not blank, -1 if one of them is no JSON, 0 if there is no such file."""
    if not _exists(spark, path):
        return spark.range(1).select(F.lit(0).cast("long").alias("n"))
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return text.agg(F.when(F.count_if(F.try_parse_json("value").isNull()) > 0, F.lit(-1).cast("long")).otherwise(F.count(F.lit(1))).alias("n"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def json_map(spark: SparkSession, path: str, value_ddl: str = "string") -> DataFrame:
    """key, value of the JSON object in a file; an empty frame if there is no such file."""
    schema = f"key string, value {value_ddl}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value_ddl}>")).alias("key", "value"))


def tagged_results(spark: SparkSession, pattern: str, schema: str = INFERENCE) -> DataFrame:
    """The records of all files of a pattern, with tag, the name of each file's folder."""
    text = spark.read.text(pattern).where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_path").alias("p"))
    return text.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("tag"), F.from_json("value", schema).alias("r")).select("tag", "r.*")


def mapped_results(spark: SparkSession, root: str, tags: DataFrame, schema: str = INFERENCE) -> DataFrame:
    """The records of all files <root>/<setting>/<stem>.jsonl with the tag that tags (setting, stem, tag) give them; files that no
    row of tags names are left out."""
    text = spark.read.text(f"{root}/*/*.jsonl").where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_path").alias("p"))
    x = text.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("setting"), F.regexp_extract("p", r"([^/]+)\.jsonl$", 1).alias("stem"), F.from_json("value", schema).alias("r"))
    return x.join(tags, ["setting", "stem"]).select("tag", "r.*")


def key_value(spark: SparkSession, path: str, value_ddl: str) -> DataFrame:
    """key, value of a table that holds a map, such as summaries or audit records by case; an error if a key comes twice."""
    x = spark.read.schema(f"key string, value {value_ddl}").parquet(path)
    if twice := x.groupBy("key").count().where("count > 1").count():
        raise ValueError(f"{twice} keys of {path} come twice")
    return x


def longest_logs(logs: DataFrame) -> DataFrame:
    """Of each tag the log with the most entries: tag, log; ties by path."""
    rank = F.row_number().over(W.partitionBy("tag").orderBy(F.size("log").desc(), "path"))
    return logs.withColumn("_k", rank).where("_k = 1").select("tag", "log")


def hinted_columns(columns: list[str], hints: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """For each name the first column that holds one of its hints, whatever the case."""
    return {name: next((c for c in columns if any(h.lower() in c.lower() for h in words)), None) for name, words in hints.items()}


def filled_down(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """Merged cells filled from above. One sheet, which one task can hold."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def synthetic_series(spark: SparkSession, sid: int, item: str, values: list[float], start: str = "2026-01-01 09:00", step_min: int = 5) -> DataFrame:
    """sid, ts, item_raw, value_raw of a series on an even grid."""
    value: Column = F.posexplode(F.array(*[F.lit(float(v)) for v in values]))
    x = spark.range(1).select(value.alias("k", "v"))
    return x.select(F.lit(sid).cast("long").alias("sid"), (F.lit(start).cast("timestamp") + F.make_dt_interval(mins=F.col("k") * step_min)).alias("ts"), F.lit(f"{item} <- {item}").alias("item_raw"), F.col("v").cast("string").alias("value_raw"))


def preflight(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, rows, columns of each input; -1 for those that can't be read."""
    out = []
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
            out.append((name, df.count(), len(df.columns)))
        except Exception:  # noqa: BLE001  whatever the reason, the input is reported as unreadable
            out.append((name, -1, -1))
    return spark.createDataFrame(out, "name string, rows long, columns int")
