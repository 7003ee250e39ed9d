"""Sinks and archive scans: field index, history tables, report archive, size statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import UNION_FIELDS


def write_field_index(packets: DataFrame, path: str, *, by=("session_id",)) -> None:
    """Permanent index of the union fields as zstd Parquet by year, month and session.

    Only the partitions present in ``packets`` are replaced, so writing a capture again changes nothing else."""
    at = F.timestamp_seconds(F.col("ts"))
    fields = [c for c in UNION_FIELDS if c in packets.columns]
    rows = packets.select(*by, *fields, F.year(at).alias("year"), F.month(at).alias("month"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("year", "month", *by).parquet(path))


def read_field_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(tables: dict[str, DataFrame], root: str, *, by=("session_id",)) -> None:
    """Result tables of an analysis, one folder each, partitioned by session; a session that is written again
    replaces its own partitions only."""
    for name, df in tables.items():
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
         .parquet(f"{root}/{name}"))


def read_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def export_stats(packets: DataFrame, raw_bytes: DataFrame | None = None, *, by=("session_id",), min_span_s: float = 60.0) -> DataFrame:
    """Rows, time span and size of the stored index per session; extrapolated per hour from a minute on.

    Sizes come from the file metadata of the scan, one value per file. ``raw_bytes`` (session, raw_bytes) adds
    the ratio to the capture."""
    per_file = packets.groupBy(*by, F.col("_metadata.file_path").alias("_file")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.max("_metadata.file_size").alias("_size"))
    out = per_file.groupBy(*by).agg(F.sum("_n").alias("rows"), (F.max("_b") - F.min("_a")).alias("duration_s"),
                                    F.sum("_size").alias("export_bytes"))
    out = out.withColumn("bytes_per_hour", F.when(F.col("duration_s") >= min_span_s, F.col("export_bytes") / F.col("duration_s") * 3600))
    if raw_bytes is None:
        return out
    return out.join(raw_bytes, list(by), "left").withColumn("ratio", F.col("raw_bytes") / F.col("export_bytes"))


ARCHIVE_SCHEMA = (
    "context struct<time_range: array<string>, original_filename: string>, results array<struct<candidate_id: string, "
    "verdict: struct<verdict: string, category: string, confidence: double, reasoning: string>, "
    "evidence: struct<device: struct<vendor: string, hostname: string>, trigger_reasons: array<string>>>>")


def read_verdict_archive(spark: SparkSession, root: str, *, pattern: str = "*/verdicts.json", multi_line: bool = True) -> DataFrame:
    """One text row per judged candidate from ``<root>/<session>/verdicts.json``, with its metadata. Archives
    kept as JSON lines in ``session_id=...`` folders are read with another pattern and ``multi_line=False``."""
    owner = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1), "^session_id=", "")
    docs = (spark.read.schema(ARCHIVE_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .json(f"{root}/{pattern}").withColumn("session_id", owner))
    when = F.get("context.time_range", F.lit(0))
    rows = docs.select("session_id", when.alias("date"),
                       F.coalesce("context.original_filename", F.concat(F.lit("session "), "session_id")).alias("file"),
                       F.explode("results").alias("r"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    device = F.concat_ws(" ", "r.evidence.device.vendor", "r.evidence.device.hostname")
    why = F.concat_ws(", ", "r.evidence.trigger_reasons")
    sentence = F.concat(
        F.lit("Session "), "session_id", F.lit(" ("), "file", F.coalesce(F.concat(F.lit(", recorded "), "date"), F.lit("")), F.lit("). "),
        F.lit("IP "), text("r.candidate_id"), F.lit(" was judged "), text("r.verdict.verdict"), F.lit(" - category "),
        text("r.verdict.category"), F.lit(", confidence "), text("r.verdict.confidence"), F.lit(". "),
        F.when(device != "", F.concat(F.lit("Device: "), device, F.lit(". "))).otherwise(""),
        F.when(why != "", F.concat(F.lit("Triggered by: "), why, F.lit(". "))).otherwise(""),
        F.lit("Reasoning: "), F.coalesce("r.verdict.reasoning", F.lit("")))
    return rows.select(
        F.concat(F.lit("session:"), "session_id", F.lit(":"), "r.candidate_id").alias("source"), F.lit(0).alias("ord"),
        sentence.alias("text"), F.create_map(
            F.lit("kind"), F.lit("verdict"), F.lit("session_id"), "session_id", F.lit("ip"), "r.candidate_id",
            F.lit("verdict"), "r.verdict.verdict", F.lit("category"), "r.verdict.category", F.lit("date"), "date").alias("meta"))


def read_report_texts(spark: SparkSession, root: str, pattern: str = "*/summary.md", kind: str = "summary") -> DataFrame:
    """Whole narrative files of the archive as (source, text, meta), ready for chunking."""
    files = spark.read.option("wholetext", True).text(f"{root}/{pattern}")
    owner = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    return files.select(F.concat(F.lit(f"{kind}:"), owner).alias("source"), F.col("value").alias("text"),
                        F.create_map(F.lit("kind"), F.lit(kind), F.lit("session_id"), owner).alias("meta"))
