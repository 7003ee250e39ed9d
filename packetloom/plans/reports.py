"""Session reports: the batch analysis from packets to ranked candidates, and the comparison of two sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time_context
from ..operators import engines, features, history as past, inventory, rankings, rules, scoring, verdicts
from ..operators.common import top_per_group
from ..operators.features import BY
from ..session import cut_lineage


def scan_report(packets: DataFrame, *, by=BY, **limits) -> DataFrame:
    """Which hosts scan, by which technique, with their features."""
    feats = features.ip_features(packets, by=by)
    alerts = rules.scan_alerts(feats, by=by, **limits)
    return alerts.join(feats.drop("count", "unique_dsts").withColumnRenamed("ip", "src"), [*by, "src"])


def candidate_context(summary: DataFrame, scored: DataFrame, ranked: DataFrame, scan: DataFrame, amp: DataFrame, arp: DataFrame, *,
                      by=BY) -> DataFrame:
    """Session totals around the candidates: model counts, rule counts, unflagged and capped hosts."""
    flagged = ranked.select(*by, "ip", "capped")
    g = scored.join(flagged, [*by, "ip"], "left").groupBy(*by).agg(
        F.count_if("anomaly").alias("forest_anomalies"), F.count_if(F.col("cluster") == -1).alias("noise"),
        F.count_if(F.col("capped").isNull()).alias("not_flagged"), F.count_if("capped").alias("capped"))
    size = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = summary.withColumnRenamed("n_pkts", "n_packets").join(g, list(by), "left")
    for df, name in ((scan, "scan_alerts"), (amp, "amp_alerts"), (arp.select(*by, "ip").distinct(), "arp_ips")):
        out = out.join(size(df, name), list(by), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def context_hosts(scored: DataFrame, ranked: DataFrame, *, by=BY) -> DataFrame:
    """Every address of a session as the context of its candidates sees it, a row each: ``section`` is flagged (a candidate within the
    cap), capped or not_flagged. An address that a rule flagged without any packet of its own has 0 packets. The reading order is that
    of `host_order` inside a section."""
    keys = [*by, "ip"]
    section = F.when(F.col("capped").isNull(), "not_flagged").when(F.col("capped"), "capped").otherwise("flagged")
    return scored.select(*keys, "count", "iso_score", "cluster", "unique_dsts").join(ranked.select(*keys, "capped", "rank"), keys, "full").select(
        *keys, section.alias("section"), "rank", F.coalesce("count", F.lit(0)).cast("bigint").alias("packets"), F.round("iso_score", 3).alias("iso_score"),
        F.col("cluster").cast("bigint").alias("cluster"), F.coalesce("unique_dsts", F.lit(0)).cast("bigint").alias("unique_dsts"))


def host_order() -> list:
    return [F.asc_nulls_last("rank"), F.desc("packets"), F.asc("ip")]


# Fixed value: address prefixes that the context of a report counts as local.
LOCAL_PREFIXES = r"^(10\.|192\.168\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|fe80:|fc|fd)"


def context_record(packets: DataFrame, scored: DataFrame, ranked: DataFrame, scan: DataFrame, amp: DataFrame, arp: DataFrame,
                   flood: DataFrame, summary: DataFrame | None = None, captures: DataFrame | None = None, *, by=BY, shown: int = 50,
                   alerts: int = 5) -> DataFrame:
    """One record per session around its candidates: size and time of the capture, who took part, what the models and rules found.

    Counts cover everything. ``not_flagged_ips`` and ``capped_details`` are the first ``shown`` hosts by packets and by address; all of
    them are in `context_hosts`. ``captures`` may add the file and sensor of a session (session_id, original_filename, sensor_name).
    Sessions without packets have no record."""
    by = list(by)
    summary = features.session_summary(packets, by=by) if summary is None else summary
    ends = packets.select(*by, F.explode(F.array("ip_src", "ip_dst")).alias("ip")).where(F.col("ip").isNotNull())
    local = F.col("ip").rlike(LOCAL_PREFIXES)
    reach = ends.distinct().groupBy(*by).agg(F.count_if(local).alias("local_ips_count"), F.count_if(~local).alias("external_ips_count"))
    protocols = features.top_n_struct(packets.where(F.col("proto").isNotNull()).groupBy(*by, "proto").agg(F.count(F.lit(1)).alias("n")),
                                      "proto", "proto", "top_protocols", by=by, n=5)
    models = scored.groupBy(*by).agg(
        F.count_if("anomaly").alias("isolation_forest_anomalies"), F.count_if(F.col("cluster") == -1).alias("dbscan_noise"),
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("dbscan_clusters"))
    hosts = context_hosts(scored, ranked, by=by)
    sections = hosts.groupBy(*by).agg(*[F.count_if(F.col("section") == s).alias(f"n_{s}") for s in ("flagged", "not_flagged", "capped")])
    heads = top_per_group(hosts.where("section <> 'flagged'"), [*by, "section"], [F.desc("packets"), F.asc("ip")], shown, "_at")
    kept = hosts.where("section = 'flagged'").groupBy(*by).agg(F.sort_array(F.collect_list("ip")).alias("flagged_ip_ids"))
    body = F.struct("_at", "section", F.struct("ip", "packets", "iso_score", "cluster", "unique_dsts").alias("h"))
    heads = heads.groupBy(*by).agg(F.sort_array(F.collect_list(body)).alias("_h"))
    pick = lambda s, f: F.transform(F.filter("_h", lambda x: x["section"] == s), f)
    text = F.concat("type", F.lit(" from `"), "src", F.lit("` ("), F.col("count").cast("string"), F.lit(" pkts, ratio "),
                    F.col("ratio").cast("string"), F.lit(")"))
    first = top_per_group(scan, by, [F.desc("count"), F.asc("src"), F.asc("type")], alerts, "_at").groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", text.alias("t")))), lambda x: x["t"]).alias("scan_alerts_summary"))
    lookups = packets.where((F.col("dns_rcode") == "3") & (F.col("dns_response") == "1")).groupBy(*by).agg(F.count(F.lit(1)).alias("dns_nxdomain"))
    out = summary.withColumnRenamed("n_pkts", "n_packets").drop("top_protocols")
    size = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    rules_found = {"scan_alerts": size(scan, "scan_alerts"), "flood_alerts": size(flood, "flood_alerts"), "amp_alerts": size(amp, "amp_alerts"),
                   "arp_spoofing_ips": size(arp.select(*by, "ip").distinct(), "arp_spoofing_ips"), "dns_nxdomain": lookups,
                   "dns_long_queries": size(features.dns_long_queries(packets, by=by), "dns_long_queries")}
    for table in (reach, protocols, models, sections, heads, kept, first, *rules_found.values()):
        out = out.join(table, by, "left")
    if captures is not None:
        out = out.join(captures.select(*by, "original_filename", "sensor_name"), by, "left")
    known = lambda c: F.col(c) if captures is not None else F.lit(None).cast("string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    none = F.array().cast("array<string>")
    clusters = F.coalesce("dbscan_clusters", F.lit(0))
    brief = lambda h: F.struct(*[h["h"][c].alias(c) for c in ("ip", "packets", "iso_score", "cluster")])
    detail = lambda h: F.struct(*[h["h"][c].alias(c) for c in ("ip", "packets", "iso_score", "unique_dsts")])
    return out.select(
        *by, "n_packets", F.round("duration_s", 1).alias("duration_s"), "t0", "t1",
        F.array(time_context(F.col("t0"))["iso_timestamp"], time_context(F.col("t1"))["iso_timestamp"]).alias("time_range"),
        F.col("n_src_ips").alias("total_ips"), zero("local_ips_count"), zero("external_ips_count"), F.col("n_macs").alias("total_macs"),
        known("original_filename").alias("original_filename"), known("sensor_name").alias("sensor_name"), "top_protocols",
        F.struct(zero("isolation_forest_anomalies"), zero("dbscan_noise"), zero("dbscan_clusters"),
                 (clusters >= 1).alias("dbscan_meaningful")).alias("ml"),
        F.struct(zero("scan_alerts"), F.coalesce("scan_alerts_summary", none).alias("scan_alerts_summary"),
                 *[zero(c) for c in rules_found if c != "scan_alerts"]).alias("rules"),
        *[zero(f"n_{s}") for s in ("flagged", "not_flagged", "capped")], F.coalesce("flagged_ip_ids", none).alias("flagged_ip_ids"),
        F.coalesce(pick("not_flagged", brief), F.array()).alias("not_flagged_ips"),
        F.coalesce(pick("capped", detail), F.array()).alias("capped_details"))


def candidate_blocks(packets: DataFrame, signals: DataFrame, risk: DataFrame, oui: DataFrame | None = None, history: DataFrame | None = None,
                     totals: DataFrame | None = None, *, by=BY) -> dict[str, DataFrame]:
    """The blocks of the candidate records by name, for `verdicts.assemble_candidates`: advanced signals, device, visited names,
    traffic, TLS and, with ``history`` (see `history.baseline_history`), prior verdicts. Without ``oui`` devices stay unknown."""
    keys = [*by, "ip"]
    top = lambda tally, key, label, out: features.top_n_struct(tally, key, label, out, by=keys)
    names = {"top_http_hosts": top(features.http_hosts_per_ip(packets, by=by), "host", "host", "top_http_hosts"),
             "top_tls_sni": top(features.tls_sni_per_ip(packets, by=by), "host", "host", "top_tls_sni"),
             "top_dns_queries": top(features.browsing_names(features.client_queries_per_ip(packets, by=by)), "qname", "host", "top_dns_queries")}
    websites = None
    for table in names.values():
        websites = table if websites is None else websites.join(table, keys, "full")
    totals = inventory.address_bytes(packets, by=by) if totals is None else totals
    ports = top(features.dst_ports_per_ip(packets, by=by), "port_proto", "port_proto", "top_dst_ports")
    # An address that only sent or only received has NULL for the other direction.
    one_way = lambda c: F.nullif(F.col(c), F.lit(0).cast("bigint"))
    traffic = totals.select(*keys, one_way("bytes_dst").alias("bytes_in"), one_way("bytes_src").alias("bytes_out")).join(ports, keys, "left")
    blocks = {"advanced_signals": engines.advanced_signals_by_ip(signals, risk, by=by).withColumnRenamed("device", "ip"),
              "websites": websites, "traffic": traffic, "tls": features.tls_summary_by_ip(packets, by=by)}
    if oui is not None:
        blocks["device_context"] = inventory.light_device_context(packets, oui, by=by)
    if history is not None:
        blocks["baseline_history"] = history
    return blocks


def analyse(packets: DataFrame, *, by=BY, providers=None, engine_limits: dict | None = None, scan=None, flood=None, amp=None,
            candidate_cap: int = 40, trees: int = 200, oui: DataFrame | None = None, history: DataFrame | None = None,
            captures: DataFrame | None = None, rate_model: bool = True, bin_s: float = 1.0) -> dict[str, DataFrame]:
    """Batch analysis. Returns the result tables by name. Feature, model and signal tables are cut to the
    checkpoint folder as they are made, because several later tables read each of them."""
    feats = cut_lineage(features.ip_features(packets, by=by))
    x = cut_lineage(scoring.standardize(feats, by=by))
    eps = cut_lineage(scoring.knn_elbow_eps(x, by=by))
    clusters = cut_lineage(scoring.dbscan(x, eps, by=by))
    scored = cut_lineage(scoring.isolation_forest(feats, by=by, trees=trees).join(clusters, [*by, "ip"]))
    signals = engines.all_signals(packets, providers, by=by, limits=engine_limits, stage_each=True)
    risk = cut_lineage(engines.kill_chain_fusion(signals, by=by))
    scan_rows, amp_rows = rules.scan_alerts(feats, by=by, **(scan or {})), rules.dns_amplification(packets, by=by, **(amp or {}))
    arp_rows, flood_rows = rules.arp_spoofing(packets, by=by), rules.syn_flood(packets, by=by, **(flood or {}))
    rate_flags = None
    if rate_model:
        flagged = scoring.rate_anomaly(packets, by=by, bin_s=bin_s).where("flagged")
        rate_flags = cut_lineage(scoring.rate_flag_counts(packets, flagged, by=by, bin_s=bin_s))
    reasons = verdicts.detector_reasons(scored, scan_rows, amp_rows, arp_rows, rate_flags, by=by)
    ranked = cut_lineage(verdicts.rank_candidates(reasons, scored, by=by, cap=candidate_cap))
    summary = cut_lineage(features.session_summary(packets, by=by))
    totals = cut_lineage(inventory.address_bytes(packets, by=by))
    blocks = candidate_blocks(packets, signals, risk, oui, history, totals, by=by)
    candidates = verdicts.assemble_candidates(ranked, scored, scan_rows, amp_rows, arp_rows, flood_rows, summary,
                                              {n: cut_lineage(t) for n, t in blocks.items()}, rate_flags, by=by)
    return {
        "ip_features": scored.join(totals.select(*by, "ip", "bytes_src", "bytes_dst"), [*by, "ip"], "left"),
        "findings": rules.findings(packets, feats, by=by, scan=scan, flood=flood, amp=amp),
        "adv_signals": signals, "fusion_scores": risk, "candidates": candidates, "session_summary": summary,
        "context": context_record(packets, scored, ranked, scan_rows, amp_rows, arp_rows, flood_rows, summary, captures, by=by),
        "context_hosts": context_hosts(scored, ranked, by=by),
    }


def compare(packets: DataFrame, s1: str, s2: str) -> dict[str, DataFrame]:
    compared = cut_lineage(rankings.session_compare(rankings.source_bytes(packets), s1, s2))
    return {"compare": compared, "churn": rankings.churn_counts(compared), "top_changes": rankings.top_changes(compared)}


def baseline_report(ip_features: DataFrame, sessions: DataFrame, now, *, z: float = 3.0, **options) -> DataFrame:
    return past.baseline_findings(past.baseline_deviations(
        ip_features, past.device_baselines(ip_features, sessions, now, **options), z=z))
