"""File sources: posts from text and JSON-lines files, whole or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_txt(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Whole files, or their parts between ``separator``; trimmed, empty ones dropped."""
    rows = spark.read.text(path, wholetext=True)
    if separator:
        import re

        rows = rows.select(F.explode(F.split("value", re.escape(separator), -1)).alias("value"))
    return rows.select(F.trim("value").alias("text")).where("text <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str = "text string, source string") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kept = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return kept.where(~bad).select("row.*").drop("_bad"), kept.where(bad).select("value")


def stream_posts(spark: SparkSession, path: str, schema: str = "id long, text string", files: int = 20) -> DataFrame:
    """Posts of the JSON-lines files of a folder as a stream, ``files`` new ones a batch. The files are read in the
    tasks from any Hadoop path; the checkpoint keeps which were seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
