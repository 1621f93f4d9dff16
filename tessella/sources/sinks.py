"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """K6, K9. One object a line, UTF-8."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K7. With a header; the byte order mark opens the header."""
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """K10. Metrics and parameters as rows, by experiment."""
    df.write.mode("append").partitionBy("experiment").parquet(path)


def report_lines(summary: DataFrame, title: str) -> DataFrame:
    """K8. Markdown lines (value) of a summary: the heading, and a line a row in the summary's order."""
    spark = summary.sparkSession
    shown = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in summary.columns])
    head = spark.createDataFrame([(f"# {title}\n",)], "value string").coalesce(1)
    return head.union(summary.select(F.concat(F.lit("- "), shown).alias("value")))


def write_report(summary: DataFrame, title: str, path: str) -> None:
    """The lines as text files, whose names are in the order of the lines; written by the tasks, however many rows there are."""
    report_lines(summary, title).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The report as one text (text), its files in order; for reports that one reader can hold."""
    parts = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"), F.col("_metadata.file_path").alias("f"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: x["t"]), "").alias("text"))


def prompt_registry(df: DataFrame) -> DataFrame:
    """F45. Prompts with the version that their text gives them."""
    return df.withColumn("version", F.substring(F.sha1("text"), 1, 12))
