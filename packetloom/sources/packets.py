"""Packet scans (batch and stream) and the normalisation every operator relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import BASE_FIELDS, LIVE_FIELDS, PACKET_FIELDS, PORT_FIELDS, raw_schema


def read_packets(spark: SparkSession, paths, sep: str = "|", fields=BASE_FIELDS, session: Column | str | None = None) -> DataFrame:
    """Header-less, unquoted delimited export (plain or compressed); every field is text.

    ``session`` names the session of the packets: a text, or an expression, for instance over ``_metadata.file_path``. By default
    every file is one capture and its whole path is the session, so equal names in different folders stay apart. A capture that
    was written in parts needs an expression, such as the folder."""
    rows = (spark.read.schema(raw_schema(fields))
            .option("sep", sep).option("header", False).option("quote", "").option("mode", "PERMISSIVE")
            .csv(paths))
    if session is None:
        session = F.col("_metadata.file_path")
    return rows.withColumn("session_id", F.lit(session))


def stream_packets(spark: SparkSession, path: str, sep: str = "|", fields=LIVE_FIELDS, min_fields: int = 16,
                   max_files_per_trigger: int | None = None, *, session: str) -> DataFrame:
    """One packet per line from a growing folder, which is the feed of one session, in the field order of live feeds; lines with
    fewer than ``min_fields`` fields are skipped, later fields that a line lacks are absent."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    parts = F.split("value", "[" + sep + "]")
    lines = reader.load(path).where(F.array_size(parts) >= min_fields)
    return lines.select(*[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(fields)], F.lit(session).alias("session_id"))


def read_packet_list(spark: SparkSession, path) -> DataFrame:
    """Packet-list CSV saved from an analyser: Latin-1 text, Length and Time default to 0, Info to ''."""
    raw = (spark.read.option("header", True).option("encoding", "ISO-8859-1").option("quote", '"')
           .option("escape", '"').csv(path))
    return raw.withColumns({
        "Info": F.coalesce(F.col("Info"), F.lit("")),
        "Length": F.coalesce(F.col("Length").try_cast("int"), F.lit(0)),
        "Time": F.coalesce(F.col("Time").try_cast("double"), F.lit(0.0)),
    })


def normalize_packets(raw: DataFrame, by=("session_id",)) -> DataFrame:
    """Typed packet table: '' becomes NULL, rows without a time are dropped, bad lengths become 0,
    the IPv6 pair fills empty IPv4 columns, the response flag becomes '1' or '0'."""
    present = set(raw.columns)
    blank_to_null = {c: F.nullif(F.col(c), F.lit("")) for c in PACKET_FIELDS
                     if c in present and c not in ("ts", "len")}
    df = raw.withColumns(blank_to_null)
    typed = {"ts": F.col("ts").try_cast("double"),
             "len": F.coalesce(F.col("len").try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))}
    typed.update({c: F.col(c).try_cast("int") for c in PORT_FIELDS if c in present})
    if "ip6_src" in present:
        typed["ip_src"] = F.coalesce("ip_src", "ip6_src")
        typed["ip_dst"] = F.coalesce("ip_dst", "ip6_dst")
    if "dns_response" in present:
        flag = F.col("dns_response")
        typed["dns_response"] = (F.when(flag.isin("1", "True", "true"), "1")
                                 .when(flag.isNull() | flag.isin("0", "False", "false"), "0").otherwise(flag))
    df = df.withColumns(typed).where(F.col("ts").isNotNull() & ~F.isnan("ts"))
    absent = [c for c in PACKET_FIELDS if c not in present]
    ports = [c for c in absent if c in PORT_FIELDS]
    fill = {c: F.lit(None).cast("int" if c in ports else "string") for c in absent}
    if missing := [key for key in by if key not in present]:
        raise ValueError(f"packets without a session: {missing}")
    return df.withColumns(fill) if fill else df
