"""Ranked views, session comparison and short insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_private
from .common import top_per_group
from .features import BY, real_dns_counts, timeline


def top_talkers(features: DataFrame, *, by=BY, n: int = 15) -> DataFrame:
    return top_per_group(features, by, [F.desc("dominance"), F.asc("ip")], n)


def top_protocols(packets: DataFrame, *, by=BY, n: int = 10) -> DataFrame:
    tally = packets.where(F.col("proto").isNotNull()).groupBy(*by, "proto").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(tally, by, [F.desc("n"), F.asc("proto")], n)


def top_dns_services(packets: DataFrame, *, by=BY, n: int = 25) -> DataFrame:
    top = top_per_group(real_dns_counts(packets, by=by), by, [F.desc("n"), F.asc("qname")], n)
    low = F.lower("qname")
    return top.withColumn("display", F.when(low.startswith("www."), low).otherwise(F.concat(F.lit("www."), low)))


def top_n_plus_others(totals: DataFrame, key: str, value: str, *, by=BY, n: int = 10, label: str = "Others",
                      counted: str | None = " IPs", only_above: int | None = None) -> DataFrame:
    """The ``n`` largest keys and one row for the rest. The rest is the total minus the top, so the full list
    is never ordered. With ``only_above`` the list is cut only when there are more keys than that."""
    top = top_per_group(totals, by, [F.desc(value), F.asc(key)], max(n, only_above or 0) + 1)
    sums = totals.groupBy(*by).agg(F.sum(value).alias("_all"), F.count(F.lit(1)).alias("_keys"))
    cut = F.lit(True) if only_above is None else F.col("_keys") > only_above
    kept = top.join(sums, list(by)).where(~cut | (F.col("rank") <= n))
    head = kept.groupBy(*by).agg(F.sum(F.when(F.col("rank") <= n, F.col(value))).alias("_top"))
    name = F.concat(F.lit(f"{label} ("), (F.col("_keys") - n).cast("string"), F.lit(f"{counted})")) if counted else F.lit(label)
    rest = (sums.join(head, list(by)).where(cut & (F.col("_all") > F.col("_top")))
            .select(*by, name.alias(key), (F.col("_all") - F.col("_top")).alias(value), F.lit(n + 1).alias("rank")))
    return kept.select(*by, key, value, "rank").unionByName(rest)


def top_sources_timeline(packets: DataFrame, features: DataFrame, *, by=BY, n: int = 6) -> DataFrame:
    """Bytes per minute, from the session start, of the sources with the most bytes."""
    top = top_per_group(features, by, [F.desc("total_bytes"), F.asc("ip")], n).select(*by, F.col("ip").alias("src"))
    rows = timeline(packets, by=by)
    start = rows.groupBy(*by).agg(F.min("time").alias("_t0"))
    return (rows.join(top, [*by, "src"], "left_semi").join(start, list(by))
            .groupBy(*by, F.floor((F.col("time") - F.col("_t0")) / 60).alias("minute"), "src")
            .agg(F.sum("size").alias("bytes")))


def session_compare(totals: DataFrame, s1: str, s2: str) -> DataFrame:
    """Source addresses of two sessions: bytes on each side, change and status.

    ``totals`` holds session_id, ip, bytes. One grouping by address replaces the full outer join."""
    pick = lambda s: F.max(F.when(F.col("session_id") == s, F.col("bytes")))
    sides = totals.where(F.col("session_id").isin(s1, s2)).groupBy("ip").agg(pick(s1).alias("b1"), pick(s2).alias("b2"))
    return sides.select(
        "ip", F.coalesce("b1", F.lit(0)).alias("bytes_s1"), F.coalesce("b2", F.lit(0)).alias("bytes_s2"),
        (F.coalesce("b2", F.lit(0)) - F.coalesce("b1", F.lit(0))).alias("change"),
        F.when(F.col("b1").isNull(), "new").when(F.col("b2").isNull(), "gone").otherwise("both").alias("status"))


def source_bytes(packets: DataFrame, *, by=BY) -> DataFrame:
    return packets.where(F.col("ip_src").isNotNull()).groupBy(*by, F.col("ip_src").alias("ip")).agg(
        F.sum("len").alias("bytes"))


def churn_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "gone", "both")])


def session_sets(totals: DataFrame, s1: str, s2: str) -> DataFrame:
    """New, gone and shared addresses as set differences and intersection."""
    a = totals.where(F.col("session_id") == s1).select("ip").distinct()
    b = totals.where(F.col("session_id") == s2).select("ip").distinct()
    tag = lambda df, name: df.select("ip", F.lit(name).alias("part"))
    return (tag(b.exceptAll(a), "new").unionByName(tag(a.exceptAll(b), "gone"))
            .unionByName(tag(a.intersect(b), "shared")))


def top_changes(compared: DataFrame, *, n: int = 15) -> DataFrame:
    """Four short lists: largest shared, largest change, largest new, largest gone."""
    both = F.col("status") == "both"
    views = F.array_compact(F.array(
        F.when(both, F.struct(F.lit("traffic").alias("view"), F.col("bytes_s1").alias("weight"))),
        F.when(both, F.struct(F.lit("change").alias("view"), F.abs("change").alias("weight"))),
        F.when(F.col("status") == "new", F.struct(F.lit("new").alias("view"), F.col("bytes_s2").alias("weight"))),
        F.when(F.col("status") == "gone", F.struct(F.lit("gone").alias("view"), F.col("bytes_s1").alias("weight")))))
    return top_per_group(compared.select("*", F.inline(views)), ["view"], [F.desc("weight"), F.asc("ip")], n)


def insights(features: DataFrame, totals: DataFrame, arp: DataFrame, dns: DataFrame, s1: str, s2: str) -> DataFrame:
    """Short statements about the two sessions, one row each. Every statement is a small aggregate."""
    mb = lambda c: F.format_string("%.1f", c / F.lit(1e6))
    local = features.where(is_private(F.col("ip"))).agg(F.max_by("ip", F.struct("dominance", "ip")).alias("ip"))
    sums = totals.where(F.col("session_id").isin(s1, s2)).groupBy("ip").agg(
        F.sum(F.when(F.col("session_id") == s1, F.col("bytes")).otherwise(0)).alias("b1"),
        F.sum(F.when(F.col("session_id") == s2, F.col("bytes")).otherwise(0)).alias("b2"))
    one = local.join(sums, "ip").select(F.lit(1).alias("ord"), F.concat(
        F.lit("Dominant LOCAL node: "), "ip", F.lit(" | S1="), mb(F.col("b1")), F.lit("MB · S2="), mb(F.col("b2")),
        F.lit("MB")).alias("line"))
    two = (totals.where((F.col("session_id") == s2) & ~is_private(F.col("ip")))
           .agg(F.max(F.struct("bytes", "ip")).alias("m")).where("m is not null")
           .select(F.lit(2).alias("ord"), F.concat(F.lit("Largest external source (S2): "), "m.ip", F.lit(" ("),
                                                   mb(F.col("m.bytes")), F.lit("MB)")).alias("line")))
    bad = arp.select("session_id", "ip").distinct().agg(F.count(F.lit(1)).alias("n"))
    three = bad.select(F.lit(3).alias("ord"), F.when(F.col("n") == 0, "ARP: CLEAN - no spoofing detected").otherwise(
        F.concat(F.lit("ARP: WARNING - "), F.col("n").cast("string"), F.lit(" suspicious IP-MAC mappings"))).alias("line"))
    churn = churn_counts(session_compare(totals, s1, s2))
    four = churn.select(F.lit(4).alias("ord"), F.concat(
        F.lit("IP churn between sessions: "), F.col("gone").cast("string"), F.lit(" gone, "), F.col("new").cast("string"),
        F.lit(" new, "), F.col("both").cast("string"), F.lit(" persistent")).alias("line"))
    top = top_per_group(dns.where(F.col("session_id") == s2), ["session_id"], [F.desc("n"), F.asc("qname")], 3)
    five = top.groupBy("session_id").agg(F.concat(F.lit("Top DNS services (S2): "), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "qname", "n"))),
        lambda s: F.concat(s["qname"], F.lit(" ("), s["n"].cast("string"), F.lit("x)"))), ", ")).alias("line")).select(
        F.lit(5).alias("ord"), "line")
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)


def view_health(view: DataFrame, value: str, *, by=(), min_rows: int = 8) -> DataFrame:
    """'empty' without rows, 'uniform' when enough rows all carry the same value, else 'ok'."""
    state = (F.when(F.count(value) == 0, "empty")
             .when((F.count(value) >= min_rows) & (F.min(value) == F.max(value)), "uniform").otherwise("ok"))
    return view.groupBy(*by).agg(state.alias("health")) if by else view.agg(state.alias("health"))
