"""Deterministic detection rules. Every threshold is an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import top_per_group
from .features import BY, arp_claims, dns_long_queries, dns_response_sizes, flag_counters, nxdomain_stats

SCAN_CLASSES = ("SYN", "FIN", "NULL", "XMAS")


def scan_alerts(features: DataFrame, *, by=BY, floor: int = 50, min_dsts: int = 20, spread_ratio: float = 0.25,
                lone_ratio: float = 0.7) -> DataFrame:
    """Sources with more than ``floor`` packets of one scan class, either to many hosts with a real share of
    such packets, or almost nothing but such packets. A projection of the feature rows: no shuffle."""
    classes = F.array(*[F.struct(F.lit(c).alias("type"), F.col(f"{c.lower()}_count").alias("flagged"))
                        for c in SCAN_CLASSES])
    ratio = F.col("flagged") / F.greatest(F.col("count"), F.lit(1))
    return (features.select(*by, "ip", "count", "unique_dsts", F.inline(classes))
            .where(F.col("flagged") > floor).withColumn("_ratio", ratio)
            .where(((F.col("unique_dsts") > min_dsts) & (F.col("_ratio") > spread_ratio))
                   | (F.col("_ratio") > lone_ratio))
            .select(*by, F.col("ip").alias("src"), "type", F.col("flagged").alias("count"), "unique_dsts",
                    F.round("_ratio", 2).alias("ratio")))


def syn_flood(packets: DataFrame, *, by=BY, min_syn: int = 1000, min_sources: int = 100, min_rate: float = 100.0,
              spoofed_max: float = 3.0) -> DataFrame:
    """Session-wide flood of SYNs, spread over so many sources that no single one stands out."""
    span = packets.groupBy(*by).agg(F.greatest(F.max("ts") - F.min("ts"), F.lit(1.0)).alias("_span"))
    totals = flag_counters(packets, by=by).where("syn_count > 0").groupBy(*by).agg(
        F.sum("syn_count").alias("total_syn"), F.count(F.lit(1)).alias("syn_sources"))
    per_source = F.col("total_syn") / F.col("syn_sources")
    rate = F.col("total_syn") / F.col("_span")
    return (totals.join(span, list(by))
            .where((F.col("total_syn") >= min_syn) & (F.col("syn_sources") >= min_sources) & (rate >= min_rate))
            .select(*by, F.lit("SYN_FLOOD").alias("type"), "total_syn", "syn_sources",
                    F.round(rate, 1).alias("syn_per_sec"), F.round(per_source, 2).alias("syn_per_source"),
                    (per_source <= spoofed_max).alias("spoofed_source_pattern")))


def dns_amplification(packets: DataFrame, *, by=BY, min_responses: int = 50, min_mean: float = 200.0) -> DataFrame:
    return (dns_response_sizes(packets, by=by)
            .where((F.col("responses") >= min_responses) & (F.col("mean_size") >= min_mean))
            .select(*by, F.col("ip").alias("src"), "responses", F.round("mean_size", 1).alias("mean_size")))


def arp_spoofing(packets: DataFrame, *, by=BY) -> DataFrame:
    """Addresses seen with more than one MAC, one row per MAC."""
    return (arp_claims(packets, by=by).where(F.col("side") == "ip")
            .select(*by, F.col("key").alias("ip"), F.col("member").alias("mac"), F.col("members").alias("n_macs")))


# Command words of the two clear-text protocols and their ports.
FTP_WORDS, FTP_PORTS = ("USER", "PASS", "RETR", "STOR"), (21,)
SMTP_WORDS, SMTP_PORTS = ("MAIL FROM", "RCPT TO", "DATA"), (25, 587)


def cleartext_credentials(packets: DataFrame, *, by=BY, shown: int = 80) -> DataFrame:
    """Payload lines with clear-text commands; a mail payload counts once per command it contains."""
    text = F.trim(F.col("payload"), F.lit(" \t\r\n"))
    ports = lambda allowed: (F.coalesce(F.col("tcp_dport").isin(*allowed), F.lit(False))
                             | F.coalesce(F.col("tcp_sport").isin(*allowed), F.lit(False)))
    hits = F.array_compact(F.array(
        *[F.when(ports(FTP_PORTS) & text.startswith(w), F.struct(F.lit("ftp").alias("protocol"), F.lit(w).alias("word")))
          for w in FTP_WORDS],
        *[F.when(ports(SMTP_PORTS) & F.col("payload").contains(w),
                 F.struct(F.lit("smtp").alias("protocol"), F.lit(w).alias("word"))) for w in SMTP_WORDS]))
    return packets.where(F.col("payload").isNotNull()).select(
        *by, "ts", F.col("ip_src").alias("src"), F.col("ip_dst").alias("dst"),
        F.substring(text, 1, shown).alias("line"), F.inline(hits))


def top_flag_sources(counters: DataFrame, *, by=BY, n: int = 10) -> DataFrame:
    """Largest sources of each flag class."""
    classes = F.array(*[F.struct(F.lit(c).alias("type"), F.col(f"{c.lower()}_count").alias("n"))
                        for c in ("SYN", "RST", "FIN", "NULL", "XMAS")])
    long = counters.select(*by, "ip", F.inline(classes)).where(F.col("n") > 0)
    return top_per_group(long, [*by, "type"], [F.desc("n"), F.asc("ip")], n)


def findings(packets: DataFrame, features: DataFrame, *, by=BY, scan=None, flood=None, amp=None) -> DataFrame:
    """Every alert as one row of the history table: layer, rule, ip, severity and the alert itself as JSON."""
    def rows(df, rule, ip, severity="high"):
        body = F.to_json(F.struct(*[c for c in df.columns if c not in by]))
        return df.select(*by, F.lit("rules").alias("layer"), F.lit(rule).alias("rule"), ip.alias("ip"),
                         F.lit(severity).alias("severity"), body.alias("detail_json"))

    none = F.lit(None).cast("string")
    parts = [
        rows(scan_alerts(features, by=by, **(scan or {})), "scan_alerts", F.col("src")),
        rows(syn_flood(packets, by=by, **(flood or {})), "flood_alerts", none),
        rows(dns_amplification(packets, by=by, **(amp or {})), "amp_alerts", F.col("src")),
        rows(arp_spoofing(packets, by=by), "arp_spoofing_ips", F.col("ip")),
        rows(dns_long_queries(packets, by=by), "dns_long_queries", none),
        rows(nxdomain_stats(packets, by=by), "dns_nxdomain", F.col("ip")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_detected_ips(scan: DataFrame, amp: DataFrame, arp: DataFrame, *, by=BY) -> DataFrame:
    return (scan.select(*by, F.col("src").alias("ip")).union(amp.select(*by, F.col("src").alias("ip")))
            .union(arp.select(*by, "ip")).distinct())
