"""Live views over a packet stream. Late rows beyond the watermark are dropped by Spark and show up in the
query progress (``numRowsDroppedByWatermark``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tcp_flag_class
from ..sources.packets import normalize_packets
from .folds import FLAGS, host_features
from .state import live_items

WATERMARK = "10 minutes"


def live_packets(raw: DataFrame, *, watermark: str = WATERMARK, by=("session_id",)) -> DataFrame:
    """Normalised stream with an event-time column and its watermark."""
    return normalize_packets(raw, by=by).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", watermark)


def within_duration(packets: DataFrame, started_at: float, limit_s: float = 3600.0) -> DataFrame:
    """Only the packets of the first ``limit_s`` seconds of the recording."""
    return packets.where(F.col("ts") <= F.lit(started_at + limit_s))


def live_ip_features(packets: DataFrame, *, window: str = "5 minutes", by=("session_id",)) -> DataFrame:
    """Feature row per source and window with the columns of the batch features, for output mode append: a window comes out when the
    watermark has passed it, and its state goes.

    Packets are summed by destination first and these sums by source, both in windowed state, so the number of destinations is exact
    and a busy source is spread over its destinations."""
    both = F.col("ip_dst").isNotNull()
    rows = packets.where(F.col("ip_src").isNotNull()).select(
        "event_time", *by, F.col("ip_src").alias("ip"), "ip_dst", "tcp_flags", F.when(both, F.col("len")).alias("_size"))
    square = (F.col("_size") * F.col("_size")).cast("decimal(19,0)")
    pairs = rows.groupBy(F.window("event_time", window).alias("w"), *by, "ip", "ip_dst").agg(
        F.count("_size").alias("count"), F.coalesce(F.sum("_size"), F.lit(0).cast("bigint")).alias("total_bytes"),
        F.coalesce(F.sum(square).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("squares"),
        *[F.count_if(F.col("tcp_flags").isNotNull() & tcp_flag_class(F.col("tcp_flags"), c)).alias(f"{c}_count") for c in FLAGS])
    hosts = host_features(pairs.withColumn("_at", F.window_time("w")), by=[F.window("_at", window).alias("w"), *by], keep=["w", *by])
    return hosts.select(F.col("w.start").alias("window_start"), "*").drop("w")


def live_arp_pairs(packets: DataFrame, *, by=("session_id",), **how) -> DataFrame:
    """Each claim of an address by a MAC when it is first seen; one that was quiet for ``idle_s`` counts as new."""
    pairs = live_items(packets, ["arp"], by=by, changes=False, **how)
    return pairs.select(*by, F.split_part("item", F.lit(" "), F.lit(1)).alias("ip"), F.split_part("item", F.lit(" "), F.lit(2)).alias("mac"), "first_ms")


def live_ports(packets: DataFrame, *, by=("session_id",), **how) -> DataFrame:
    """Each port of an address when it is first seen; one that was quiet for ``idle_s`` counts as new."""
    pairs = live_items(packets, ["port"], by=by, changes=False, **how)
    return pairs.select(*by, F.split_part("item", F.lit(" "), F.lit(1)).alias("ip"), F.split_part("item", F.lit(" "), F.lit(2)).cast("int").alias("port"), "first_ms")


def tumbling_series(packets: DataFrame, window: str = "1 second", *, by=("session_id",)) -> DataFrame:
    """Packets, bytes and mean size per window, for output mode append."""
    rows = packets.where(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())
    return rows.groupBy(F.window("event_time", window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"), F.avg("len").alias("mean_size")).select(
        F.col("w.start").alias("window_start"), *by, "packets", "bytes", "mean_size")


def sliding_fusion(signals: DataFrame, *, by=("session_id",), window: str = "15 minutes", slide: str = "1 minute",
                   watermark: str = WATERMARK) -> DataFrame:
    """Early risk per device over sliding windows of a signal stream. The batch fusion with exact trailing
    windows is the authority. Techniques are a small fixed vocabulary, so the sets stay short."""
    timed = signals.withColumn("event_time", F.timestamp_seconds("first_ts")).withWatermark("event_time", watermark)
    g = timed.groupBy(F.window("event_time", window, slide).alias("w"), *by, "device").agg(
        F.count(F.lit(1)).alias("signals"), F.max("score").alias("max_score"), F.collect_set("technique").alias("_t"))
    boost = 1 + 0.5 * (F.greatest(F.size("_t"), F.lit(1)) - 1)
    return g.select(F.col("w.start").alias("window_start"), *by, "device", "signals", F.round("max_score", 3).alias("max_score"),
                    F.round(F.least(F.lit(1.0), F.col("max_score") * boost), 3).alias("risk"),
                    F.array_join(F.sort_array("_t"), ";").alias("techniques"))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """Uploads sent again are dropped by content hash, however late; state holds one hash per distinct upload."""
    return chunks.dropDuplicates(["sha256"])
