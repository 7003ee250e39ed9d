"""Per-host features, counters and distinct pairs of the packet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    flag_class, is_long_query, strip_trailing_dots, tcp_flag_int, tls_version_label, weak_cipher, weak_tls_version,
)
from ..functions.names import is_mdns_device_name, is_real_dns
from .common import counts, dealt, first_per_group, members_text, top_per_group

BY = ("session_id",)


def _has(column: str):
    return F.col(column).isNotNull()


def flag_counters(packets: DataFrame, *, by=BY) -> DataFrame:
    """SYN, RST, FIN, NULL and XMAS packets per source; the destination may be absent."""
    rows = packets.where(_has("tcp_flags") & _has("ip_src")).select(
        *by, F.col("ip_src").alias("ip"), tcp_flag_int(F.col("tcp_flags")).alias("_flags"))
    return rows.groupBy(*by, "ip").agg(*[
        F.count_if(flag_class(F.col("_flags"), c)).alias(f"{c}_count") for c in ("syn", "rst", "fin", "null", "xmas")])


def ip_features(packets: DataFrame, *, by=BY) -> DataFrame:
    """Feature row per source: volume over rows that have both ends, flag counters over all its rows.

    One scan and one grouping; Spark first combines by (source, destination), so a source talking to
    very many hosts is spread before its final row is made."""
    size = F.col("_size")
    rows = packets.where(_has("ip_src")).select(
        *by, F.col("ip_src").alias("ip"), "ip_dst", F.when(_has("ip_dst"), F.col("len")).alias("_size"),
        F.when(_has("tcp_flags"), tcp_flag_int(F.col("tcp_flags"))).alias("_flags"))
    agg = dealt(rows, packets.count(), *by, "ip", "ip_dst").groupBy(*by, "ip").agg(
        F.count(size).alias("count"),
        F.sum(size).alias("total_bytes"),
        F.avg(size).alias("mean_len"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("std_len"),
        F.count_distinct("ip_dst").alias("unique_dsts"),
        *[F.count_if(flag_class(F.col("_flags"), c)).alias(f"{c}_count") for c in ("syn", "rst", "fin", "null", "xmas")])
    flags = [f"{c}_count" for c in ("syn", "rst", "fin", "null", "xmas")]
    return agg.where(F.col("count") > 0).select(
        *by, "ip", "count", "total_bytes", "mean_len", "std_len", "unique_dsts",
        (F.col("count") / (F.col("std_len") + 1)).alias("burst_score"),
        (F.col("count") + F.col("total_bytes") / 1000).alias("dominance"), *flags)


def attach_counters(features: DataFrame, counters: DataFrame, *, by=BY) -> DataFrame:
    """Left join of per-host counters on a feature table, 0 where a host has none."""
    keys = [*by, "ip"]
    extra = [c for c in counters.columns if c not in keys]
    joined = features.drop(*extra).join(counters, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in extra})


def traffic_totals(packets: DataFrame, *, by=BY) -> DataFrame:
    """Packets and bytes by source, destination, protocol, MAC and host pair from one scan."""
    def dim(name, key, key2=F.lit(None).cast("string")):
        return F.struct(F.lit(name).alias("dimension"), key.alias("key"), key2.alias("key2"))

    pair = F.when(_has("ip_src") & _has("ip_dst"), F.col("ip_src"))
    dims = F.array(dim("src", F.col("ip_src")), dim("dst", F.col("ip_dst")), dim("proto", F.col("proto")),
                   dim("mac", F.col("eth_src")), dim("pair", pair, F.col("ip_dst")))
    long = packets.select(*by, "len", F.inline(dims)).where(_has("key"))
    return long.groupBy(*by, "dimension", "key", "key2").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"))


def session_summary(packets: DataFrame, *, by=BY, top: int = 5) -> DataFrame:
    base = packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pkts"), F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        F.count_distinct("ip_src").alias("n_src_ips"), F.count_distinct("eth_src").alias("n_macs"),
    ).withColumn("duration_s", F.col("t1") - F.col("t0"))
    return base.join(top_protocols_text(packets, by=by, n=top), list(by), "left")


def top_protocols_text(packets: DataFrame, *, by=BY, n: int = 5) -> DataFrame:
    ranked = top_per_group(counts(packets, *by, "proto"), by, [F.desc("n"), F.asc("proto")], n)
    return ranked.groupBy(*by).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "proto", "n"))),
        lambda s: F.concat(s["proto"], F.lit(":"), s["n"].cast("string"))), ";").alias("top_protocols"))


def arp_pairs(packets: DataFrame, *, by=BY) -> DataFrame:
    """Distinct (ip, mac) claims, without the unset address."""
    return packets.where(_has("arp_psrc") & _has("arp_hwsrc") & (F.col("arp_psrc") != "0.0.0.0")).select(
        *by, F.col("arp_psrc").alias("ip"), F.col("arp_hwsrc").alias("mac")).distinct()


def arp_claims(packets: DataFrame, *, by=BY, min_members: int = 2) -> DataFrame:
    """Addresses claimed by several MACs and MACs claiming several addresses, one row per member."""
    pairs = arp_pairs(packets, by=by)
    sides = pairs.select(*by, F.inline(F.array(
        F.struct(F.lit("ip").alias("side"), F.col("ip").alias("key"), F.col("mac").alias("member")),
        F.struct(F.lit("mac").alias("side"), F.col("mac").alias("key"), F.col("ip").alias("member")))))
    keys = [*by, "side", "key"]
    sizes = sides.groupBy(*keys).agg(F.count("member").alias("members")).where(F.col("members") >= min_members)
    return sides.join(sizes, keys)


def dns_response_sizes(packets: DataFrame, *, by=BY) -> DataFrame:
    rows = packets.where((F.col("dns_response") == "1") & (F.col("udp_sport") == 53) & _has("ip_src"))
    return rows.groupBy(*by, F.col("ip_src").alias("ip")).agg(
        F.count(F.lit(1)).alias("responses"), F.sum("len").alias("total_bytes"), F.avg("len").alias("mean_size"))


def _names(packets: DataFrame, by=BY) -> DataFrame:
    q = strip_trailing_dots(F.col("dns_qname"))
    return (packets.where(_has("dns_qname") & (F.length("dns_qname") > 3))
            .withColumn("qname", q).where(F.length("qname") > 3))


def dns_query_counts(packets: DataFrame, *, by=BY) -> DataFrame:
    """Names seen in queries and responses alike."""
    return counts(_names(packets, by), *by, "qname")


def real_dns_counts(packets: DataFrame, *, by=BY) -> DataFrame:
    return dns_query_counts(packets, by=by).where(is_real_dns(F.col("qname")))


def mdns_device_names(packets: DataFrame, *, by=BY) -> DataFrame:
    return (_names(packets, by).where(is_mdns_device_name(F.col("qname"))).select(*by, "qname").distinct())


def dns_long_queries(packets: DataFrame, *, by=BY, limit: int = 60) -> DataFrame:
    return _names(packets, by).where(is_long_query(F.col("qname"), limit)).select(*by, "qname").distinct()


def dns_timeline(packets: DataFrame, *, by=BY) -> DataFrame:
    return _names(packets, by).where(_has("ip_src")).select(*by, "ts", F.col("ip_src").alias("ip"), "qname")


def timeline(packets: DataFrame, *, by=BY) -> DataFrame:
    return packets.where(_has("ip_src") & _has("ip_dst")).select(
        *by, F.col("ts").alias("time"), F.col("ip_src").alias("src"), F.col("ip_dst").alias("dst"),
        F.col("len").alias("size"))


def nxdomain_stats(packets: DataFrame, *, by=BY) -> DataFrame:
    """Failed lookups per receiving host; rows without a receiver count under NULL."""
    rows = packets.where((F.col("dns_rcode") == "3") & (F.col("dns_response") == "1"))
    return rows.groupBy(*by, F.col("ip_dst").alias("ip")).agg(F.count(F.lit(1)).alias("nxdomain"))


def dns_nonstandard_ports(packets: DataFrame, *, by=BY, ports=(53, 5353)) -> DataFrame:
    rows = packets.where(_has("dns_qname") & _has("udp_dport") & (F.col("dns_response") != "1"))
    return rows.groupBy(*by).agg(F.count_if(~F.col("udp_dport").isin(*ports)).alias("nonstandard"))


def client_queries_per_ip(packets: DataFrame, *, by=BY) -> DataFrame:
    rows = (packets.where(_has("dns_qname") & _has("ip_src") & (F.col("dns_response") != "1"))
            .select(*by, F.col("ip_src").alias("ip"), strip_trailing_dots(F.col("dns_qname")).alias("qname")))
    return counts(rows.where(F.col("qname") != ""), *by, "ip", "qname")


def dst_ports_per_ip(packets: DataFrame, *, by=BY) -> DataFrame:
    port = lambda c, p: F.when(_has(c), F.concat(F.col(c).cast("string"), F.lit(p)))
    rows = packets.where(_has("ip_src")).select(
        *by, F.col("ip_src").alias("ip"),
        F.explode(F.array_compact(F.array(port("tcp_dport", "/tcp"), port("udp_dport", "/udp")))).alias("port_proto"))
    return counts(rows, *by, "ip", "port_proto")


def hosts_per_ip(packets: DataFrame, column: str, *, by=BY) -> DataFrame:
    """(ip, host) counts of one host column: http_host or tls_sni."""
    return counts(packets.select(*by, F.col("ip_src").alias("ip"), F.col(column).alias("host")), *by, "ip", "host")


def http_hosts_per_ip(packets: DataFrame, *, by=BY) -> DataFrame:
    return hosts_per_ip(packets, "http_host", by=by)


def tls_sni_per_ip(packets: DataFrame, *, by=BY) -> DataFrame:
    return hosts_per_ip(packets, "tls_sni", by=by)


def ip_mac_counts(packets: DataFrame, *, by=BY) -> DataFrame:
    return counts(packets.select(*by, F.col("ip_src").alias("ip"), F.col("eth_src").alias("mac")), *by, "ip", "mac")


def dominant_mac(packets: DataFrame, *, by=BY) -> DataFrame:
    """Most common MAC of each address; ties go to the smaller MAC text."""
    return first_per_group(ip_mac_counts(packets, by=by), [*by, "ip"], [F.desc("n"), F.asc("mac")])


def ip_ports(packets: DataFrame, *, by=BY) -> DataFrame:
    """Distinct (ip, port) over all four port columns."""
    ports = F.array_compact(F.array("tcp_sport", "tcp_dport", "udp_sport", "udp_dport"))
    return (packets.where(_has("ip_src")).select(*by, F.col("ip_src").alias("ip"), F.explode(ports).alias("port"))
            .distinct())


def ports_per_ip(packets: DataFrame, *, by=BY) -> DataFrame:
    return ip_ports(packets, by=by).groupBy(*by, "ip").agg(F.count("port").alias("n_ports"))


def ip_mdns_names(packets: DataFrame, *, by=BY) -> DataFrame:
    return (dns_timeline(packets, by=by).where(F.col("qname").endswith(".local"))
            .select(*by, "ip", F.col("qname").alias("name")).distinct())


def mdns_names_per_ip(packets: DataFrame, *, by=BY, limit: int = 1000) -> DataFrame:
    """The first ``limit`` names of an address as text and how many it has; `ip_mdns_names` has all, a row each."""
    return members_text(ip_mdns_names(packets, by=by), [*by, "ip"], "name", "names", limit, "n_names")


def wlan_features(packets: DataFrame, *, by=BY) -> DataFrame:
    """Per transmitter: frame counts by kind, signal samples and time span. A session in which no frame has a
    signal reading yields no rows."""
    num = lambda c: F.col(c).try_cast("double")
    whole = lambda c: num(c).cast("bigint")
    first = lambda c: F.split(F.col(c), ",")[0].try_cast("double")
    rows = packets.where(_has("wlan_sa")).select(
        *by, F.lower("wlan_sa").alias("mac"), "ts", whole("wlan_type").alias("t"), whole("wlan_subtype").alias("s"),
        whole("wlan_retry").alias("r"), F.coalesce(first("rssi_radiotap"), first("rssi_wlanradio")).alias("rssi"))
    mgmt = F.col("t") == 0
    agg = rows.groupBy(*by, "mac").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(mgmt & (F.col("s") == 4)).alias("probe_requests"),
        F.count_if(mgmt & F.col("s").between(0, 3)).alias("association_frames"),
        F.count_if(mgmt & F.col("s").isin(10, 12)).alias("deauth_frames"),
        F.count_if(F.col("r") == 1).alias("retries"),
        F.count("rssi").alias("rssi_samples"), F.avg("rssi").alias("mean_rssi"),
        F.coalesce(F.stddev_pop("rssi"), F.lit(0.0)).alias("std_rssi"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))

    def spread(column, out):
        tally = counts(rows, *by, "mac", column).withColumn(
            "_kv", F.concat(F.lpad(F.col(column).cast("string"), 4, "0"), F.lit(":"), F.col("n").cast("string")))
        return members_text(tally, [*by, "mac"], "_kv", out)

    heard = agg.groupBy(*by).agg(F.sum("rssi_samples").alias("_heard")).where(F.col("_heard") > 0).select(*by)
    keys = [*by, "mac"]
    return (agg.join(heard, list(by), "left_semi").join(spread("t", "frame_types"), keys, "left")
            .join(spread("s", "subtypes"), keys, "left"))


def dominant_ssid_bssid(packets: DataFrame, *, by=BY) -> DataFrame:
    """Most common network name and access-point address of beacon and probe-response frames."""
    frames = packets.where((F.col("wlan_type") == "0") & F.col("wlan_subtype").isin("8", "5"))
    bssid = F.lower(F.trim("wlan_bssid"))
    colons = F.length(bssid) - F.length(F.translate(bssid, ":", ""))
    ssid = F.trim("wlan_ssid")
    best_b = first_per_group(counts(frames.where(colons == 5).withColumn("bssid", bssid), *by, "bssid"), by,
                             [F.desc("n"), F.asc("bssid")]).select(*by, "bssid")
    best_s = first_per_group(
        counts(frames.where((ssid != "") & ssid.rlike("^[ -~]+$")).withColumn("ssid", ssid), *by, "ssid"), by,
        [F.desc("n"), F.asc("ssid")]).select(*by, "ssid")
    return best_b.join(best_s, list(by), "full")


def tls_summary_by_ip(packets: DataFrame, *, by=BY, top: int = 5) -> DataFrame:
    """Per source: most frequent protocol versions, number of weak ciphers, any weak version at all."""
    rows = packets.where(_has("tls_version") & _has("ip_src")).withColumnRenamed("ip_src", "ip")
    keys = [*by, "ip"]
    totals = rows.groupBy(*keys).agg(
        F.count_if(weak_cipher(F.col("tls_cipher"))).alias("weak_cipher_count"),
        F.bool_or(weak_tls_version(F.col("tls_version"))).alias("has_weak_version"))
    ranked = top_per_group(counts(rows, *keys, "tls_version"), keys, [F.desc("n"), F.asc("tls_version")], top)
    versions = ranked.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "tls_version", "n"))),
        lambda s: F.struct(tls_version_label(s["tls_version"]).alias("version"), s["n"].alias("count")),
    ).alias("versions"))
    return totals.join(versions, keys)


def top_n_struct(tally: DataFrame, key: str, label: str, out: str, *, by=(*BY, "ip"), n: int = 5) -> DataFrame:
    """Array of {label, count} of the n largest positive counts per group; no row for an empty group."""
    rows = tally.where((F.col("n") > 0) & _has(key) & (F.col(key) != ""))
    ranked = top_per_group(rows, by, [F.desc("n"), F.asc(key)], n)
    return ranked.groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", key, "n"))),
        lambda s: F.struct(s[key].alias(label), s["n"].alias("count"))).alias(out))


def browsing_names(tally: DataFrame) -> DataFrame:
    """Query counts without local discovery and reverse lookups."""
    q = F.col("qname")
    return tally.where(~q.endswith(".local") & ~q.endswith(".arpa") & ~q.startswith("_"))
