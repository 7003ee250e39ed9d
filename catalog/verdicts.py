"""Candidates, verdict checks, panels, comparison, quality, retrieval."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from packetloom.functions import verdict_cache_key
from packetloom.operators import browsing as B, engines as E, features as A, history as H, inventory as I, retrieval as X, rules as D, scoring as S, verdicts as V
from packetloom.plans import reports
from packetloom.session import cut_lineage

from .base import PACKETS_SQL, Catalog, packets, rd, rdd, stored, table
from .detection import LOW_AMP, LOW_FLOOD, LOW_SCAN, RISK_SQL, SIGNALS_SQL_R, _AMP, _FLOOD, _fused, scan_sql, signals
from .features import TLS_SUM_SQL, W, WF
from .history import _SE, _VD, NOW, _now, _sessions
from .inventory import RATE_SQL, oui

C = Catalog()

# Votes and verdicts derived from the conversations: one panel per conversation, one judge per role and turn.
_VOTE = {
    "conv_id": "conv_id", "seat": "turn", "model": "concat(role, '-', cast(turn % 3 as string))",
    "session_id": "case when conv_id % 2 = 0 then 'S1' else 'S2' end",
    "ip": "concat('10.0.', cast(conv_id % 7 as string), '.', cast(turn as string), '-', cast(cast(floor(conv_id / 2) as bigint) as string))",
    "verdict": "case {n} % 6 when 0 then 'benign' when 1 then 'benign' when 2 then 'suspicious' when 3 then 'malicious' when 4 then 'malicious' else null end",
    "category": "case {n} % 3 when 0 then 'benign_anomaly' when 1 then 'port_scan' else 'dns_amp' end",
    "confidence": "cast({n} % 100 as double) / 100",
    "initial_verdict": "case {n} % 4 when 0 then 'benign' when 1 then 'malicious' else 'suspicious' end",
    "revised": "{n} % 4 = 1", "cached": "{n} % 7 = 0", "latency_ms": "{n} % 900",
    "error": "case {n} % 6 when 5 then case turn % 4 when 0 then 'Limit: tokens per minute (TPM) reached' when 1 then 'Daily Quota timed out' when 2 then 'HTTP 400 json_schema' else 'odd failure - details' end end",
    "iso_score": "case when {n} % 9 = 0 then null else cast({n} % 41 as double) / 40 - 0.5 end",
    "flag_mass": "{n} % 8", "unique_dsts": "{n} % 2", "scan_fired": "{n} % 5 = 0",
    "reasoning": "concat('seen  as Public Resolver ', role)",
}


def _vote_exprs(n):
    return [f"{e.replace('{n}', n)} as {c}" for c, e in _VOTE.items()]


VOTES = "with votes as (select " + ", ".join(_vote_exprs("strlen(text)")) + " from conversations) "


def votes(spark, d):
    return table(spark, d, "conversations").selectExpr(*_vote_exprs("cast(octet_length(text) as bigint)"))


# ---- candidates -------------------------------------------------------------------------------

_SC = WF + f""", {scan_sql()} {_AMP} {_FLOOD}, arpc as (select session_id, arp_psrc as ip from packets where arp_psrc <> '0.0.0.0' and arp_hwsrc is not null group by all having count(distinct arp_hwsrc) > 1),
  scored as (select *, "count" / 10.0 - 1 as iso_score, "count" % 7 = 0 as anomaly, case when "count" % 5 = 0 then -1 else 0 end as cluster from features),
  rs as (select session_id, ip, 'isolation_forest' as reason from scored where anomaly union select session_id, ip, 'dbscan_noise' from scored where cluster = -1 union select session_id, src, 'scan_rule' from scan
    union select session_id, src, 'amp_rule' from amp union select session_id, ip, 'arp_rule' from arpc),
  rk as (select session_id, ip, string_agg(distinct reason, ';' order by reason) as trigger_reasons, bool_or(reason in ('scan_rule', 'amp_rule', 'arp_rule')) as by_rule from rs group by all),
  rr as (select rk.*, iso_score, row_number() over (partition by rk.session_id order by by_rule desc, iso_score nulls last, rk.ip) as r from rk left join scored s on s.session_id = rk.session_id and s.ip = rk.ip) """


def _scored(spark, d):
    f = A.ip_features(packets(spark, d))
    return f.withColumns({"iso_score": F.expr("count / 10 - 1"), "anomaly": F.expr("count % 7 = 0"), "iso_stability": F.expr("cast(count % 7 = 0 as double)"),
                          "cluster": F.expr("case when count % 5 = 0 then -1 else 0 end")})


def _candidates(spark, d):
    # Each of these is read by several blocks, so it is made once.
    p, s = packets(spark, d), cut_lineage(_scored(spark, d))
    scan, amp, arp = map(cut_lineage, (D.scan_alerts(s, **LOW_SCAN), D.dns_amplification(p, **LOW_AMP), D.arp_spoofing(p)))
    r = V.detector_reasons(s, scan, amp, arp)
    return p, s, scan, amp, arp, r


@C.add("u03_detector_reasons", _SC + "select * from rs")
def _(spark, d):
    return _candidates(spark, d)[-1]


@C.add("v01_rank_candidates", _SC + f"select session_id, ip, trigger_reasons, by_rule, {rd('iso_score')} as iso_score, case when r <= 40 then r end as rank, r > 40 as capped from rr")
def _(spark, d):
    _, s, _, _, _, r = _candidates(spark, d)
    return V.rank_candidates(r, s)


# Prior verdicts on addresses of the packets, from the orders.
_SEEN = "concat('10.0.0.', cast(o_custkey % 200 + 1 as string))"


def _history(spark, d):
    o = table(spark, d, "orders")
    v = o.selectExpr("o_orderkey as session_id", "1 as candidate_row", f"{_VD} as verdict")
    c = o.selectExpr("o_orderkey as session_id", "1 as candidate_row", f"{_SEEN} as candidate_id")
    return H.baseline_history(v, c, _sessions(spark, d), _now())


# Minutes with a mean size above 700 stand for the bins that a rate model flags.
_RATE_FLAGS = """, rfl as (select session_id, bin from rate where mean_size > 700), rby as (select session_id, ip_src as ip, cast(floor((ts - t0) / 60) as bigint) as bin, sum(len) as sent from packets join b0 using (session_id)
    where ip_src is not null and ip_dst is not null group by all),
  rfc as (select session_id, ip, count(*) as bin_flag_count from (select session_id, bin, ip from rby join rfl using (session_id, bin) qualify row_number() over (partition by session_id, bin order by sent desc, ip) = 1) group by all) """


def _rate_flags(spark, d):
    p = packets(spark, d)
    return S.rate_flag_counts(p, B.rate_series(p, bin_s=60).where("mean_size > 700"), bin_s=60)


@C.add("v01_rate_attribution", RATE_SQL + _RATE_FLAGS + "select * from rfc")
def _(spark, d):
    return _rate_flags(spark, d)


def _assembled(spark, d):
    """The candidate records as they are kept per session: written once, read by the checks of their blocks."""
    return stored(spark, d, "candidate_records", lambda: _records(spark, d))


def _records(spark, d):
    p, s, scan, amp, arp, r = _candidates(spark, d)
    blocks = {n: cut_lineage(t) for n, t in reports.candidate_blocks(p, signals(spark, d), _fused(spark, d), oui(spark), _history(spark, d)).items()}
    ranked = cut_lineage(V.rank_candidates(r, s))
    return V.assemble_candidates(ranked, cut_lineage(s), scan, amp, arp, D.syn_flood(p, **LOW_FLOOD), A.session_summary(p), blocks, _rate_flags(spark, d))


@C.add("v01_assemble_candidates", _SC + """select session_id, candidate_id, kind, rank, trigger_reasons, n_scan, packets from (
  select session_id, ip as candidate_id, 'ip' as kind, case when r <= 40 then r end as rank, trigger_reasons, (select count(*) from scan where scan.session_id = rr.session_id and scan.src = rr.ip) as n_scan,
    (select "count" from features f where f.session_id = rr.session_id and f.ip = rr.ip) as packets from rr
  union all select session_id, 'session:' || session_id, 'session', null, 'flood_rule', null, null from flood)""")
def _(spark, d):
    a = _assembled(spark, d)
    return a.select("session_id", "candidate_id", "kind", "rank", F.array_join("trigger_reasons", ";").alias("trigger_reasons"),
                    F.size("rule_signals.scan_alerts").alias("n_scan"), F.col("features.count").cast("bigint").alias("packets")).withColumn(
        "n_scan", F.when(F.col("kind") == "ip", F.col("n_scan")))


def _top5(name, rows):
    return f"""{name} as (select session_id, ip, string_agg(h || '=' || n, ';' order by n desc, h) as v from (select session_id, ip, h, count(*) as n from ({rows}) where ip is not null and h is not null and h <> '' group by session_id, ip, h
    qualify row_number() over (partition by session_id, ip order by count(*) desc, h) <= 5) group by all)"""


_WEB = (", " + _top5("whttp", "select session_id, ip_src as ip, http_host as h from packets") + ", " + _top5("wsni", "select session_id, ip_src as ip, tls_sni as h from packets") + ", "
        + _top5("wdns", "select * from (select session_id, ip_src as ip, rtrim(dns_qname, '.') as h from packets where dns_response <> '1') where not ends_with(h, '.local') and not ends_with(h, '.arpa') and not starts_with(h, '_')") + ", "
        + _top5("wport", "select session_id, ip_src as ip, tcp_dport || '/tcp' as h from packets union all select session_id, ip_src, udp_dport || '/udp' from packets")
        + """, wio as (select session_id, ip, nullif(sum(o), 0) as o, nullif(sum(i), 0) as i from (select session_id, ip_src as ip, len as o, 0 as i from packets union all select session_id, ip_dst, 0, len from packets) where ip is not null group by all),
  ctx as (select session_id, min(ts) as t0, max(ts) - min(ts) as dur, count(*) as np, count(distinct ip_src) as nip from packets group by all) """)


@C.add("v01_candidate_surroundings", TLS_SUM_SQL + _SC[len(W) - 1:] + _WEB + f"""select rr.session_id, rr.ip as candidate_id, whttp.v as http_hosts, wsni.v as tls_sni, wdns.v as dns_queries, wport.v as ports, cast(o as bigint) as bytes_out, cast(i as bigint) as bytes_in,
  case when o + i > 0 then {rdd('o / (o + i)', 3)} end as upload_ratio, tsum.versions as tls_versions, weak_cipher_count, has_weak_version, {rdd('dur', 1)} as duration_s, np as total_packets, nip as total_ips,
  strftime(make_timestamp(cast(floor(t0) as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S') as iso_timestamp, hour(make_timestamp(cast(floor(t0) as bigint) * 1000000)) as hour_of_day, strftime(make_timestamp(cast(floor(t0) as bigint) * 1000000), '%a') as day_of_week
  from rr join ctx using (session_id) """ + "".join(f"left join {t} on {t}.session_id = rr.session_id and {t}.ip = rr.ip " for t in ("whttp", "wsni", "wdns", "wport", "wio", "tsum")))
def _(spark, d):
    a = _assembled(spark, d).where("kind = 'ip'")
    flat = lambda c, label="host": F.expr(f"array_join(transform({c}, x -> concat(x.{label}, '=', x.count)), ';')")
    return a.select("session_id", "candidate_id", flat("websites.top_http_hosts").alias("http_hosts"), flat("websites.top_tls_sni").alias("tls_sni"), flat("websites.top_dns_queries").alias("dns_queries"),
                    flat("traffic.top_dst_ports", "port_proto").alias("ports"), "traffic.bytes_out", "traffic.bytes_in", "traffic.upload_ratio", flat("tls.versions", "version").alias("tls_versions"),
                    "tls.weak_cipher_count", "tls.has_weak_version", "session_context.duration_s", "session_context.total_packets", "session_context.total_ips", "session_context.iso_timestamp",
                    "session_context.hour_of_day", "session_context.day_of_week")


def _apart(ctes, others):
    """CTEs renamed where another part of the statement uses their names."""
    names = lambda text: set(re.findall(r"\b(\w+) as \(select", text))
    for name in names(ctes) & names(others):
        ctes = re.sub(rf"\b{name}\b", f"{name}_c", ctes)
    return ctes


@C.add("v01_candidate_signals", SIGNALS_SQL_R + RISK_SQL + _apart(_SC[len(W) - 1:], SIGNALS_SQL_R + RISK_SQL) + f""", cw as (select session_id, device, case when signal = 'beaconing' then 'b' when signal in ('dns_tunneling', 'nxdomain_storm') then 'd' when signal = 'dga_domain' then 'g' when signal in ('rare_ja3', 'tls_no_sni_external', 'sni_ip_mismatch') then 't' end as e, severity || ':' || "count" || ':' || peer as v,
    row_number() over (partition by session_id, device, e order by score desc, first_ts, peer desc) as r from sig where device <> ''),
  cw1 as (select session_id, device as ip, max(v) filter (e = 'b') as beaconing, max(v) filter (e = 'd') as dns_tunneling, max(v) filter (e = 'g') as dga, max(v) filter (e = 't') as tls_anomaly from cw where r = 1 group by all),
  cfu as (select session_id, device as ip, {rdd('least(1.0, base * boost)', 3)} as fusion, len(string_split(techniques, ';')) as techniques from risk where device <> ''),
  tl as (select session_id, ts, len from packets where ip_src is not null and ip_dst is not null), b0 as (select session_id, min(ts) as t0 from tl group by all),
  rate as (select session_id, cast(floor((ts - t0) / 60) as bigint) as bin, avg(len) as mean_size from tl join b0 using (session_id) group by all) {_RATE_FLAGS},
  ses as (select """ + ", ".join(_SE) + f""" from orders), hv as (select {_SEEN} as ip, {_VD} as verdict, finished_at from orders join ses on id = o_orderkey where status = 'done'),
  hg as (select ip, min(finished_at) as f, count(*) filter (verdict = 'benign') as b, count(*) filter (verdict = 'suspicious') as s, count(*) filter (verdict = 'malicious') as m, count(*) filter (finished_at is null) as nn from hv group by ip),
  hist as (select ip, true as seen_before, case when nn > 0 then null else cast(floor((epoch_us({NOW}) - epoch_us(f)) / 86400000000.0) as bigint) end as days_since_first_seen,
    nullif(concat_ws(' · ', case when b > 0 then b || '/' || (b + s + m) || ' benign' end, case when s > 0 then s || '/' || (b + s + m) || ' suspicious' end, case when m > 0 then m || '/' || (b + s + m) || ' malicious' end), '') as prior_verdict_summary from hg)
  select rr.session_id, rr.ip as candidate_id, fusion, techniques, beaconing, dns_tunneling, dga, tls_anomaly, bin_flag_count as lstm_bin_flag_count, seen_before, days_since_first_seen, prior_verdict_summary, {rdd('iso_score', 4)} as iso_score, f."count"::double as n_packets,
    {rdd('f.mean_len', 4)} as mean_len, 0::bigint as n_floods from rr """ + "".join(f"left join {t} on {t}.session_id = rr.session_id and {t}.ip = rr.ip " for t in ("cfu", "cw1", "rfc")) + """left join hist on hist.ip = rr.ip left join features f on f.session_id = rr.session_id and f.ip = rr.ip
  union all select session_id, 'session:' || session_id, null, null, null, null, null, null, null, null, null, null, null, null, null, 1::bigint from flood""")
def _(spark, d):
    t = lambda c: F.expr(f"{c}.severity || ':' || {c}.count || ':' || {c}.peer").alias(c.split(".")[1])
    return _assembled(spark, d).select(
        "session_id", "candidate_id", F.col("advanced_signals.fusion_score.score").alias("fusion"), F.col("advanced_signals.fusion_score.techniques").alias("techniques"),
        *[t(f"advanced_signals.{e}") for e in ("beaconing", "dns_tunneling", "dga", "tls_anomaly")], "ml_signals.lstm_bin_flag_count", "baseline_history.seen_before",
        "baseline_history.days_since_first_seen", "baseline_history.prior_verdict_summary", "ml_signals.iso_score", F.col("features.count").alias("n_packets"), F.col("features.mean_len").alias("mean_len"),
        F.size("rule_signals.flood_alerts").alias("n_floods"))


@C.add("v13_evidence_projection", _SC + f""", pc as (select session_id, ip, pt, count(*) as n, row_number() over (partition by session_id, ip order by count(*) desc, pt) as r from (select session_id, ip_src as ip, tcp_dport || '/tcp' as pt from packets union all select session_id, ip_src, udp_dport || '/udp' from packets)
    where ip is not null and pt is not null group by session_id, ip, pt),
  tw as (select session_id, ip_src as ip, bool_or(tls_version in ('0x0300', '0x0301', '0x0302') or coalesce(lower(tls_cipher) in ('0x0001','0x0002','0x0003','0x0004','0x0005','0x0006','0x0008','0x0009','0x000a'), false)) as weak from packets where tls_version is not null group by all)
  select rr.session_id, rr.ip as candidate_id, f."count" as packets, f.unique_dsts, f.syn_count, {rd('iso_score')} as iso_score, (select string_agg(pt || '=' || n, ';' order by r) from (select * from pc where r <= 3) pc where pc.session_id = rr.session_id and pc.ip = rr.ip) as top_dst_ports,
  case when weak then true end as tls_weak from rr left join features f on f.session_id = rr.session_id and f.ip = rr.ip left join tw on tw.session_id = rr.session_id and tw.ip = rr.ip""")
def _(spark, d):
    e = V.evidence_projection(_assembled(spark, d).where("kind = 'ip'"))
    return e.select("session_id", "candidate_id", "packets", "unique_dsts", "syn_count", "iso_score",
                    F.expr("array_join(transform(top_dst_ports, x -> concat(x.port_proto, '=', x.count)), ';')").alias("top_dst_ports"), "tls_weak")


@C.add("a27_candidate_context", _SC + """select f.session_id, any_value(np) as n_packets, count(*) filter (anomaly) as forest_anomalies, count(*) filter (cluster = -1) as noise, count(*) filter (rr.ip is null) as not_flagged,
  count(*) filter (rr.r > 40) as capped, any_value((select count(*) from scan where scan.session_id = f.session_id)) as scan_alerts, any_value((select count(*) from amp where amp.session_id = f.session_id)) as amp_alerts, any_value((select count(*) from arpc where arpc.session_id = f.session_id)) as arp_ips
  from scored f left join rr on rr.session_id = f.session_id and rr.ip = f.ip join (select session_id, count(*) as np from packets group by all) z on z.session_id = f.session_id group by f.session_id""")
def _(spark, d):
    p, s, scan, amp, arp, r = _candidates(spark, d)
    return reports.candidate_context(A.session_summary(p), s, V.rank_candidates(r, s), scan, amp, arp).select(
        "session_id", "n_packets", "forest_anomalies", "noise", "not_flagged", "capped", "scan_alerts", "amp_alerts", "arp_ips")


_LOCAL = "regexp_matches(ip, '^(10[.]|192[.]168[.]|127[.]|169[.]254[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|fe80:|fc|fd)')"
_HOSTS = ", hosts as (select coalesce(s.session_id, rr.session_id) as session_id, coalesce(s.ip, rr.ip) as ip, case when rr.ip is null then 'not_flagged' when r > 40 then 'capped' else 'flagged' end as section, case when r <= 40 then r end as rank, coalesce(\"count\", 0) as packets, " + rdd("s.iso_score", 3) + """ as iso_score,
  cast(cluster as bigint) as cluster, coalesce(unique_dsts, 0) as unique_dsts from scored s full join rr on rr.session_id = s.session_id and rr.ip = s.ip) """


@C.add("a27_context_hosts", _SC + _HOSTS + "select * from hosts")
def _(spark, d):
    _, s, _, _, _, r = _candidates(spark, d)
    return reports.context_hosts(s, V.rank_candidates(r, s))


@C.add("a27_context_record", _SC + _HOSTS + f""", ends as (select distinct session_id, ip from (select session_id, ip_src as ip from packets union all select session_id, ip_dst from packets) where ip is not null),
  re as (select session_id, count(*) filter ({_LOCAL}) as local_ips_count, count(*) filter (not {_LOCAL}) as external_ips_count from ends group by all),
  su as (select session_id, count(*) as n_packets, {rdd('max(ts) - min(ts)', 1)} as duration_s, strftime(make_timestamp(cast(floor(max(ts)) as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S') as time_end, count(distinct ip_src) as total_ips, count(distinct eth_src) as total_macs,
    count(*) filter (dns_rcode = '3' and dns_response = '1') as dns_nxdomain, count(distinct case when length(rtrim(dns_qname, '.')) > 60 then rtrim(dns_qname, '.') end) as dns_long_queries from packets group by all),
  pr as (select session_id, string_agg(proto || '=' || n, ';' order by n desc, proto) as top_protocols from (select session_id, proto, count(*) as n from packets where proto is not null group by session_id, proto qualify row_number() over (partition by session_id order by count(*) desc, proto) <= 5) group by all),
  ml as (select session_id, count(*) filter (anomaly) as isolation_forest_anomalies, count(*) filter (cluster = -1) as dbscan_noise, count(distinct cluster) filter (cluster <> -1) as dbscan_clusters from scored group by all),
  hc as (select session_id, count(*) filter (section = 'flagged') as n_flagged, count(*) filter (section = 'not_flagged') as n_not_flagged, count(*) filter (section = 'capped') as n_capped, string_agg(ip, ';' order by ip) filter (section = 'flagged') as flagged from hosts group by all),
  hd as (select session_id, section, string_agg(ip || ':' || packets || case when section = 'capped' then ':' || unique_dsts else ':' || cluster end, ';' order by packets desc, ip) as v from (select * from hosts where section <> 'flagged' qualify row_number() over (partition by session_id, section order by packets desc, ip) <= 50) group by all),
  sm as (select session_id, string_agg(type || ' from `' || src || '` (' || "count" || ' pkts, ratio ' || ratio || ')', ';' order by "count" desc, src, type) as scan_summary from (select * from scan qualify row_number() over (partition by session_id order by "count" desc, src, type) <= 5) group by all),
  ct as (select session_id, (select count(*) from scan x where x.session_id = su.session_id) as scan_alerts, (select count(*) from flood x where x.session_id = su.session_id) as flood_alerts, (select count(*) from amp x where x.session_id = su.session_id) as amp_alerts,
    (select count(distinct ip) from arpc x where x.session_id = su.session_id) as arp_spoofing_ips from su)
  select *, (select v from hd where hd.session_id = su.session_id and section = 'not_flagged') as not_flagged, (select v from hd where hd.session_id = su.session_id and section = 'capped') as capped, dbscan_clusters >= 1 as dbscan_meaningful, 'S.pcap' as original_filename, case session_id when 'S1' then 'north' end as sensor_name
  from su join re using (session_id) join pr using (session_id) join ml using (session_id) join hc using (session_id) join ct using (session_id) left join sm using (session_id)""")
def _(spark, d):
    p, s, scan, amp, arp, r = _candidates(spark, d)
    captures = p.groupBy("session_id").agg(F.lit("S.pcap").alias("original_filename")).withColumn("sensor_name", F.expr("case session_id when 'S1' then 'north' end"))
    c = reports.context_record(p, s, cut_lineage(V.rank_candidates(r, s)), scan, amp, arp, D.syn_flood(p, **LOW_FLOOD), captures=captures)
    flat = lambda e, f: F.expr(f"nullif(array_join(transform({e}, x -> {f}), ';'), '')")
    return c.select("session_id", "n_packets", "duration_s", F.col("time_range")[1].alias("time_end"), "total_ips", "local_ips_count", "external_ips_count", "total_macs", "original_filename", "sensor_name",
                    flat("top_protocols", "x.proto || '=' || x.count").alias("top_protocols"), "ml.*", *[F.col(f"rules.{n}") for n in ("scan_alerts", "flood_alerts", "amp_alerts", "arp_spoofing_ips", "dns_nxdomain", "dns_long_queries")],
                    flat("rules.scan_alerts_summary", "x").alias("scan_summary"), "n_flagged", "n_not_flagged", "n_capped", flat("flagged_ip_ids", "x").alias("flagged"),
                    flat("not_flagged_ips", "x.ip || ':' || x.packets || ':' || x.cluster").alias("not_flagged"), flat("capped_details", "x.ip || ':' || x.packets || ':' || x.unique_dsts").alias("capped"))


# ---- verdict checks ---------------------------------------------------------------------------

_JSON = "case conv_id % 8 when 0 then 'nonsense' when 1 then '{\"verdict\": \"benign\"}' else concat('{\"verdict\": \"', case when conv_id % 8 = 2 then 'odd' else coalesce(verdict, 'benign') end, '\", \"category\": \"', category, '\", \"confidence\": ', case when conv_id % 8 = 3 then '1.5' when conv_id % 8 = 4 then '\"0.5\"' else cast(seat as string) end, ', \"evidence_features\": ', case when conv_id % 8 = 5 then '\"x\"' else '[\"features.count\", \"a.b[1]\"]' end, ', \"reasoning\": \"', case when conv_id % 8 = 6 then '  ' else 'so   it is' end, '\", \"recommended_action\": \"monitor\"}') end"


@C.add("v02_validate_verdict", VOTES + """select conv_id, seat, case conv_id % 8 when 0 then 'not an object' when 1 then 'missing fields' when 2 then 'bad verdict' when 3 then 'confidence outside [0, 1]' when 4 then 'confidence outside [0, 1]'
  else case when seat > 1 then 'confidence outside [0, 1]' when conv_id % 8 = 5 then 'evidence_features is not a list' when conv_id % 8 = 6 then 'reasoning is empty' end end as reject_reason,
  case when conv_id % 8 = 7 and seat <= 1 then coalesce(verdict, 'benign') end as verdict, case when conv_id % 8 = 7 and seat <= 1 then seat::double end as confidence, case when conv_id % 8 = 7 and seat <= 1 then 'so it is' end as reasoning from votes""")
def _(spark, d):
    v = votes(spark, d).select("conv_id", "seat", F.expr(_JSON).alias("verdict_json"))
    return V.validate_verdict(v).select("conv_id", "seat", "reject_reason", "verdict", "confidence", "reasoning")


@C.add("v03_verdict_semantics", VOTES + f""", s as (select *, category = 'port_scan' and not scan_fired and flag_mass < 5 and unique_dsts = 1 as ns from votes), t as (select *, case when ns and verdict = 'malicious' then 'suspicious' else verdict end as v1 from s)
  select conv_id, seat, case when v1 = 'malicious' and confidence < 0.5 then 'suspicious' else v1 end as verdict, case when ns then 'benign_anomaly' else category end as category,
  concat_ws(';', case when ns then 'port_scan_without_flags_or_rule' end, case when v1 = 'malicious' and confidence < 0.5 then 'confidence_floor_downgrade' end) as notes from t""")
def _(spark, d):
    return V.verdict_semantics(votes(spark, d)).select("conv_id", "seat", "verdict", "category", F.array_join("notes", ";").alias("notes"))


@C.add("v04_evidence_check", VOTES + """select conv_id, seat, seat % 2 = 1 as evidence_valid, case when seat % 2 = 1 then '' else 'a.x;b[7].c' end as invalid from votes""")
def _(spark, d):
    v = votes(spark, d).select("conv_id", "seat", F.lit('{"a": {"b": [1, {"c": 2}], "n": null}, "b": []}').alias("candidate_json"),
                               F.expr("case when seat % 2 = 1 then array('a.b[1].c', 'a.b[0]') else array('a.x', 'a.b', 'b[7].c') end").alias("evidence_features"))
    return V.evidence_check(v).select("conv_id", "seat", "evidence_valid", F.array_join("evidence_invalid_features", ";").alias("invalid"))


_EXPECT = "case conv_id % 5 when 0 then 'syn_flood' when 1 then 'arp_mitm' when 2 then 'dns_amp' when 3 then 'port_scan' end"
_CITES = "case when seat % 2 = 0 then array('rule_signals.amp_alerts[0]', 'x') else array('features.count') end"


@C.add("v05_rule_guardrail", VOTES + f""", g as (select *, {_EXPECT} as e, verdict = 'benign' and {_EXPECT} is not null as ag from votes), h as (select *, coalesce(ag and e = 'dns_amp' and seat % 2 = 0 and confidence >= 0.85, false) as byp from g)
  select conv_id, seat, case when ag and not byp then 'suspicious' else verdict end as verdict, case when ag and not byp then e else category end as category, case when ag and not byp then greatest(confidence, 0.6) else confidence end as confidence,
  case when ag and not byp and seat % 2 = 1 then 'rule_signals;features.count' when seat % 2 = 0 then 'rule_signals.amp_alerts[0];x' else 'features.count' end as evidence, coalesce(ag and not byp, false) as guardrail_applied, byp as guardrail_bypassed from h""")
def _(spark, d):
    v = votes(spark, d).withColumns({"expected_category": F.expr(_EXPECT), "evidence_features": F.expr(_CITES), "recommended_action": F.lit("monitor")})
    return V.rule_guardrail(v).select("conv_id", "seat", "verdict", "category", "confidence", F.array_join("evidence_features", ";").alias("evidence"),
                                      "guardrail_applied", "guardrail_bypassed")


@C.add("v06_priority_score", VOTES + f""", b as (select *, min(iso_score) over (partition by session_id) as lo, max(iso_score) over (partition by session_id) as hi from votes)
  select conv_id, seat, {rdd("0.2 * case when iso_score is not null and hi > lo then (hi - iso_score) / (hi - lo) else 0 end + 0.4 * confidence + 0.3 * case category when 'benign_anomaly' then 0.0 when 'port_scan' then 0.8 else 1.0 end + 0.1 * (seat % 3) / 2.0", 4)} as priority from b""")
def _(spark, d):
    return V.priority_score(votes(spark, d).withColumn("ti_score", F.expr("cast(seat % 3 as double) / 2"))).select("conv_id", "seat", "priority")


@C.add("j16_worst_peer_reputation", W + f""", pp as (select session_id, ip_src as ip, ip_dst as peer, count(*) as n from packets where ip_src is not null and (ip_dst like '52.%' or ip_dst like '142.%' or ip_dst like '157.%' or ip_dst like '8.8.%' or ip_dst like '203.7.%' or ip_dst like '198.100.%' or ip_dst like '2600:%') group by all),
  tp as (select *, row_number() over (partition by session_id, ip order by n desc, peer) as r from pp qualify r <= 5), sc as (select *, least(length(peer) % 4 * 0.2, 0.6) + case when peer like '52.%' then 0.4 else 0 end as s from tp)
  select session_id, ip, {rdd('max(s)', 4)} as ti_score, arg_min(peer, (-round(s, 4), r)) as peer from sc where s > 0 group by all""")
def _(spark, d):
    p = packets(spark, d)
    pairs = A.traffic_totals(p).where("dimension = 'pair'").select("session_id", F.col("key").alias("src"), F.col("key2").alias("dst"), "packets")
    intel = pairs.select(F.col("dst").alias("ip")).distinct().selectExpr(
        "ip", "case when length(ip) % 4 > 0 then transform(sequence(1, length(ip) % 4), x -> concat('CVE-', x)) else array() end as vulns",
        "case when ip like '52.%' then array('TOR') else array() end as tags", "array(1) as ports")
    return V.worst_peer_reputation(pairs.select("session_id", F.col("src").alias("ip")), pairs, intel)


# ---- panels -----------------------------------------------------------------------------------

@C.add("v07_committee", VOTES + """, a as (select * from votes where seat = 0), b as (select * from votes where seat = 1), j as (select coalesce(a.conv_id, b.conv_id) as conv_id, a.verdict as va, a.confidence as ca, a.category as ka, b.verdict as vb, b.confidence as cb, b.category as kb,
    case when a.verdict = b.verdict then a.confidence >= b.confidence else list_position(['benign', 'suspicious', 'malicious'], a.verdict) >= list_position(['benign', 'suspicious', 'malicious'], b.verdict) end as fa from a full join b on a.conv_id = b.conv_id)
  select conv_id, case when va is null then vb when vb is null then va when fa then va else vb end as verdict, case when va is null and vb is null then null when va is null then kb when vb is null then ka when fa then ka else kb end as category,
  case when va is null and vb is null then null when va is null then cb when vb is null then ca when fa then ca else cb end as confidence, coalesce(va = vb, false) as agreement, not coalesce(va = vb, false) as needs_human_review,
  case when va = vb then null when va is not null and vb is not null then 'judges disagree; using the more severe verdict' when va is not null then 'only judge A returned a valid verdict' when vb is not null then 'only judge B returned a valid verdict' else 'both judges failed' end as note from j""")
def _(spark, d):
    v = votes(spark, d)
    return V.committee(v.where("seat = 0"), v.where("seat = 1"), ["conv_id"])


PANEL = VOTES + """, ok as (select * from votes where verdict is not null), lb as (select conv_id, verdict, count(*) as n, arg_max((category, confidence, model), (confidence, -seat)) as best, max(confidence) as mc from ok group by all),
  tot as (select c.conv_id, count(verdict) as nv, count(distinct verdict) as nl, count(distinct case when verdict is not null then category end) as nc, arg_max((verdict, category, confidence, model), (confidence, -seat)) filter (verdict is not null) as best from votes c group by c.conv_id),
  won as (select tot.*, (select verdict from lb where lb.conv_id = tot.conv_id and n * 2 > nv) as maj, (select verdict from lb where lb.conv_id = tot.conv_id order by list_position(['benign', 'suspicious', 'malicious'], verdict) desc limit 1) as worst,
    (select max(n) from lb where lb.conv_id = tot.conv_id) as topn from tot),
  fin as (select won.*, case when nl = 1 then won.best[1] else coalesce(maj, worst) end as verdict from won),
  res as (select fin.conv_id, nv as n_valid, fin.verdict, case when nl = 1 then fin.best[2] else lb.best[1] end as category, case when nl = 1 then fin.best[3] else lb.best[2] end as confidence, case when nl = 1 then fin.best[4] else lb.best[3] end as model,
    nl = 1 and nc = 1 and nv > 1 as agreement, not ((nl = 1 and nc = 1 and nv > 1) or (nl > 1 and maj is not null)) as needs_human_review,
    case when nv = 0 then 'every panel judge failed' when nv = 1 then 'only one panel judge returned a valid verdict' when nl = 1 and nc = 1 then null when nl = 1 then 'judges agree on the verdict but dispute the category'
      when maj is not null then 'panel resolved by majority (' || topn || '/' || nv || ' chose ''' || maj || ''')' else 'judges disagree after debate; using the more severe verdict' end as note
    from fin left join lb on lb.conv_id = fin.conv_id and lb.verdict = fin.verdict) """


def _panel(spark, d):
    v = votes(spark, d)
    return v, V.panel_resolve(v, ["conv_id"])


@C.add("v08_panel_resolve", PANEL + "select * from res")
def _(spark, d):
    return _panel(spark, d)[1]


@C.add("v09_panel_disagrees", VOTES + "select conv_id, count(distinct verdict) > 1 or count(distinct category) > 1 as disagrees from votes where verdict is not null group by all")
def _(spark, d):
    return V.panel_disagrees(votes(spark, d), ["conv_id"])


@C.add("v10_votes_summary", PANEL + """select conv_id, n_valid, case when n_valid = 0 then '-' when n_valid = 1 then '1 judge' when needs_human_review then n_valid || ' split' when (select bool_or(revised) from ok where ok.conv_id = res.conv_id) then n_valid || ' agreed in debate'
  else n_valid || '/' || n_valid || ' unanimous' end as votes from res""")
def _(spark, d):
    return V.votes_summary(*_panel(spark, d), ["conv_id"])


_HEALTH = PANEL + """, h as (select votes.model, count(*) as assigned, count(votes.verdict) as valid, count(*) - count(votes.verdict) as failures, count(*) filter (cached) as cache_hits, count(*) filter (revised) as revised, count(*) filter (votes.verdict = res.verdict) as agreed_with_final,
  cast(floor(sum(latency_ms) / count(*)) as bigint) as mean_latency_ms, count(votes.verdict) < count(*) / 2 as degraded from votes join res using (conv_id) group by votes.model) """


@C.add("a24_panel_health", _HEALTH + "select * from h")
def _(spark, d):
    return V.panel_health(*_panel(spark, d), ["conv_id"])


@C.add("v12_panel_audit_rows", _HEALTH + """select conv_id::varchar as candidate_id, votes.model as judge_model, initial_verdict, votes.verdict as final_verdict, revised::bigint as revised, needs_human_review::bigint as needs_review, error from votes join res using (conv_id)
  union all select '*', model, '{"agreed_with_final":' || agreed_with_final || ',"assigned":' || assigned || ',"failures":' || failures || ',"valid":' || valid || '}', null, revised, 0, null from h""")
def _(spark, d):
    v, r = _panel(spark, d)
    return V.panel_audit_rows(v, r, V.panel_health(v, r, ["conv_id"]), ["conv_id"])


_MODELS = [f"{r}-{i}" for r in ("system", "user", "assistant") for i in range(3)]
_CELL = "case when verdict is null then '_failed_' when revised and initial_verdict <> verdict then substr(initial_verdict, 1, 3) || '→' || substr(verdict, 1, 3) || format(' {:.2f}', confidence) || ' ↺' else substr(verdict, 1, 3) || format(' {:.2f}', confidence) end"


@C.add("v15_vote_matrix", VOTES + f", c as (select conv_id, model, {_CELL} as cell from votes) select conv_id, " + ", ".join(f"min(cell) filter (model = '{m}') as \"{m}\"" for m in _MODELS) + " from c group by conv_id")
def _(spark, d):
    return V.vote_matrix(votes(spark, d), ["conv_id"], _MODELS)


@C.add("v14_failure_causes", VOTES + """select conv_id, seat, case seat % 4 when 0 then 'rate throttle (TPM)' when 1 then 'daily quota;timeout' when 2 then 'JSON format unsupported' else 'odd failure' end as causes from votes where error is not null""")
def _(spark, d):
    return V.failure_causes(votes(spark, d).where("error is not null")).select("conv_id", "seat", F.array_join("causes", ";").alias("causes"))


@C.add("v11_cache_split", "select conv_id, turn, case when conv_id % 3 = 0 then 'reused' else 'to judge' end as part from (select *, min(conv_id % 3) over (partition by text, role) as m from conversations) where true".replace("case when conv_id % 3 = 0", "case when m = 0"))
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", verdict_cache_key(F.col("text"), F.lit("v"), F.col("role")).alias("cache_key"))
    reuse, todo = V.cache_split(c, c.where("conv_id % 3 = 0").select("cache_key").distinct())
    return reuse.select("conv_id", "turn", F.lit("reused").alias("part")).unionByName(todo.select("conv_id", "turn", F.lit("to judge").alias("part")))


@C.add("a23_verdict_counts", VOTES + "select session_id, count(*) filter (verdict = 'malicious') as malicious, count(*) filter (verdict = 'suspicious') as suspicious, count(*) filter (verdict = 'benign') as benign from votes group by all")
def _(spark, d):
    return V.verdict_counts(votes(spark, d))


@C.add("a25_quota_usage", """with c as (select event_type as provider, ts::date as day, count(*) as requests, cast(sum(cast(floor(value) as bigint)) as bigint) as tokens, max(case when event_id % 17 = 0 then ts end) as l from events group by all)
  select provider, strftime(day, '%Y-%m-%d') as day, requests, tokens, l is not null and requests >= 70 as exhausted from c""")
def _(spark, d):
    calls = table(spark, d, "events").selectExpr("event_type as provider", "ts as called_at", "cast(floor(value) as bigint) as tokens", "event_id % 17 = 0 as was_429")
    return V.is_exhausted(V.quota_usage(calls), request_cap=70).select("provider", F.date_format("day", "yyyy-MM-dd").alias("day"), "requests", "tokens", "exhausted")


# ---- comparison -------------------------------------------------------------------------------

_PAIR = VOTES + """, s1 as (select * from votes where session_id = 'S1'), s2 as (select * from votes where session_id = 'S2'), dd as (select coalesce(a.k, b.k) as ip, a.verdict as verdict_s1, a.category as category_s1, a.confidence as confidence_s1, b.verdict as verdict_s2, b.category as category_s2, b.confidence as confidence_s2,
    case when b.k is null then 'only_s1' when a.k is null then 'only_s2' when a.verdict = b.verdict then 'unchanged' when a.verdict is not null and b.verdict is not null then 'flip' else 'unknown' end as change
    from (select *, regexp_replace(ip, '^10.0.[0-9]+.', '') as k from s1) a full join (select *, regexp_replace(ip, '^10.0.[0-9]+.', '') as k from s2) b on a.k = b.k),
  df as (select *, case when change = 'flip' then verdict_s1 || ' -> ' || verdict_s2 end as flow from dd) """


def _diff(spark, d):
    v = votes(spark, d).withColumn("ip", F.regexp_replace("ip", "^10.0.[0-9]+.", ""))
    return V.verdict_pair_diff(v.where("session_id = 'S1'"), v.where("session_id = 'S2'"))


@C.add("j17_verdict_pair_diff", _PAIR + "select * from df")
def _(spark, d):
    return _diff(spark, d)


@C.add("c02_pair_change_counts", _PAIR + "select change, flow, count(*) as n from df group by all")
def _(spark, d):
    return V.pair_change_counts(_diff(spark, d))


_SEV = "list_position(['benign', 'suspicious', 'malicious'], {0}) desc"


@C.add("c02_pair_highlights", _PAIR + f""", h as (select 'only_s1' as section, ip, verdict_s1 as verdict, category_s1 as category, confidence_s1 as confidence, flow, row_number() over (order by {_SEV.format('verdict_s1')} nulls last, confidence_s1 desc nulls last, ip) as rank from df where change = 'only_s1'
  union all select 'only_s2', ip, verdict_s2, category_s2, confidence_s2, flow, row_number() over (order by {_SEV.format('verdict_s2')} nulls last, confidence_s2 desc nulls last, ip) from df where change = 'only_s2'
  union all select 'flips', ip, verdict_s2, category_s2, confidence_s2, flow, row_number() over (order by ip) from df where change = 'flip')
  select * from h where rank <= 20 union all select 'top_s1', ip, verdict_s1, category_s1, confidence_s1, flow, row_number() over (order by confidence_s1 desc, ip) as rank from df where verdict_s1 in ('malicious', 'suspicious') qualify rank <= 3
  union all select 'top_s2', ip, verdict_s2, category_s2, confidence_s2, flow, row_number() over (order by confidence_s2 desc, ip) as rank from df where verdict_s2 in ('malicious', 'suspicious') qualify rank <= 3""")
def _(spark, d):
    return V.pair_highlights(_diff(spark, d))


_DEV = "nullif(concat_ws(' ', case when seat % 3 = 0 then null else 'Acme' end, case when seat % 2 = 0 then 'host' || seat end), '')"


@C.add("c02_pair_report", f"with {PACKETS_SQL}, " + _PAIR[5:].replace("a.verdict as verdict_s1", "a.device as device_s1, b.device as device_s2, a.verdict as verdict_s1").replace("select *, regexp_replace", f"select *, {_DEV} as device, regexp_replace") + f""",
  o1 as (select *, row_number() over (order by {_SEV.format('verdict_s1')} nulls last, coalesce(confidence_s1, 0) desc, ip) as r from df where change = 'only_s1' qualify r <= 20), o2 as (select *, row_number() over (order by {_SEV.format('verdict_s2')} nulls last, coalesce(confidence_s2, 0) desc, ip) as r from df where change = 'only_s2' qualify r <= 20),
  fl as (select *, row_number() over (order by ip) as r from df where change = 'flip' qualify r <= 20), b1 as (select *, row_number() over (order by coalesce(confidence_s1, 0) desc, ip) as r from df where verdict_s1 in ('malicious', 'suspicious') qualify r <= 3),
  b2 as (select *, row_number() over (order by coalesce(confidence_s2, 0) desc, ip) as r from df where verdict_s2 in ('malicious', 'suspicious') qualify r <= 3), cap as (select session_id, min(ts) as t0 from packets group by all)
  select 'S1' as s1, 'S2' as s2, count(*) filter (change <> 'only_s2') as total_s1, count(*) filter (change <> 'only_s1') as total_s2, count(*) filter (verdict_s1 = 'malicious' and change <> 'only_s2') as malicious_s1, count(*) filter (verdict_s2 = 'benign' and change <> 'only_s1') as benign_s2,
  count(*) filter (change = 'only_s1') as only_s1_total, count(*) filter (change = 'only_s2') as only_s2_total, count(*) filter (change = 'flip') as flip_total, count(*) filter (change = 'unchanged') as unchanged,
  (select string_agg(flow || '=' || n, ';' order by flow) from (select flow, count(*) as n from df where flow is not null group by flow)) as category_flow,
  (select string_agg(ip || ':' || coalesce(verdict_s1, '') || ':' || confidence_s1 || ':' || coalesce(device_s1, ''), ';' order by r) from o1) as only_s1, (select string_agg(ip || ':' || coalesce(verdict_s2, '') || ':' || confidence_s2 || ':' || coalesce(device_s2, ''), ';' order by r) from o2) as only_s2,
  (select string_agg(ip, ';' order by r) from o2 where verdict_s2 in ('malicious', 'suspicious')) as new_non_benign_s2, (select string_agg(ip || ':' || flow || ':' || confidence_s1 || ':' || confidence_s2 || ':' || category_s2 || ':' || coalesce(device_s2, ''), ';' order by r) from fl) as flips,
  (select string_agg(ip || ':' || verdict_s1 || ':' || confidence_s1, ';' order by r) from b1) as top_non_benign_s1, (select string_agg(ip || ':' || verdict_s2 || ':' || confidence_s2, ';' order by r) from b2) as top_non_benign_s2,
  cast(round((select t0 from cap where session_id = 'S2') - (select t0 from cap where session_id = 'S1')) as bigint) as gap_seconds from df""")
def _(spark, d):
    v = votes(spark, d).withColumn("ip", F.regexp_replace("ip", "^10.0.[0-9]+.", "")).withColumns(
        {"vendor": F.expr("case when seat % 3 = 0 then null else 'Acme' end"), "hostname": F.expr("case when seat % 2 = 0 then 'host' || seat end")})
    captures = A.session_summary(packets(spark, d)).select("session_id", "t0", "n_pkts")
    r = V.pair_report(v.where("session_id = 'S1'"), v.where("session_id = 'S2'"), captures)
    flat = lambda c, f: F.expr(f"nullif(array_join(transform({c}, x -> {f}), ';'), '')").alias(c)
    side = "x.ip || ':' || coalesce(x.verdict, '') || ':' || x.confidence || ':' || coalesce(x.device, '')"
    best = "x.ip || ':' || x.verdict || ':' || x.confidence"
    return r.select("s1", "s2", "total_s1", "total_s2", F.col("counts_s1.malicious").alias("malicious_s1"), F.col("counts_s2.benign").alias("benign_s2"), "only_s1_total", "only_s2_total", "flip_total", "unchanged",
                    F.expr("nullif(array_join(array_sort(transform(map_entries(category_flow), x -> x.key || '=' || x.value)), ';'), '')").alias("category_flow"), flat("only_s1", side), flat("only_s2", side),
                    flat("new_non_benign_s2", "x.ip"), flat("flips", "x.ip || ':' || x.from || ' -> ' || x.to || ':' || x.from_confidence || ':' || x.to_confidence || ':' || x.s2_category || ':' || coalesce(x.device, '')"),
                    flat("top_non_benign_s1", best), flat("top_non_benign_s2", best), "gap_seconds")


_POST = "case {n} % 4 when 0 then 'stable' when 1 then 'mixed' when 2 then 'escalated' else 'de-escalated' end"


@C.add("c03_pair_posture_vote", "with a as (select conv_id, " + _POST.replace("{n}", "strlen(text)") + """ as posture, strlen(text) % 100 / 100.0::double as confidence, role || '-' || turn as model from conversations),
  g as (select conv_id, posture, count(*) as votes, arg_max(model, (confidence, model)) as model, max(confidence) as confidence, sum(count(*)) over (partition by conv_id) as answered from a group by conv_id, posture)
  select conv_id, posture, votes, model, confidence, cast(answered as bigint) as answered from g qualify row_number() over (partition by conv_id order by votes desc, list_position(['stable', 'de-escalated', 'mixed', 'escalated'], posture) desc) = 1""")
def _(spark, d):
    a = table(spark, d, "conversations").selectExpr("conv_id", _POST.replace("{n}", "octet_length(text)") + " as posture", "octet_length(text) % 100 / 100 as confidence", "concat(role, '-', turn) as model")
    return V.pair_posture_vote(a, ["conv_id"])


@C.add("u05_notable_flips", VOTES + """, o as (select conv_id, regexp_replace(ip, '-.*', '') as ip, confidence, model from votes qualify row_number() over (partition by conv_id, regexp_replace(ip, '-.*', '') order by confidence desc, model) = 1)
  select *, row_number() over (partition by conv_id order by confidence desc, ip) as rank from o qualify rank <= 5""")
def _(spark, d):
    return V.notable_flips(votes(spark, d).select("conv_id", F.regexp_replace("ip", "-.*", "").alias("ip"), "confidence", "model"), ["conv_id"])


# ---- quality ----------------------------------------------------------------------------------

_LAB = ("with lab as (select doc_id, case when toxic = 1 then 'port_scan' when quality = 1 then 'benign_anomaly' else 'dns_amp' end as true_category, "
        "case when n_chars % 5 = 0 then 'port_scan' when n_chars % 5 < 4 and quality = 1 then 'benign_anomaly' when n_chars % 5 = 4 then 'arp_mitm' else 'dns_amp' end as category from labels join documents using (doc_id)) ")


def _lab(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.selectExpr("doc_id", "case when toxic = 1 then 'port_scan' when quality = 1 then 'benign_anomaly' else 'dns_amp' end as true_category",
                        "case when n_chars % 5 = 0 then 'port_scan' when n_chars % 5 < 4 and quality = 1 then 'benign_anomaly' when n_chars % 5 = 4 then 'arp_mitm' else 'dns_amp' end as category")


@C.add("q01_prf", _SC + """, t as (select distinct session_id, arp_psrc as ip from packets where arp_psrc is not null), dt as (select distinct session_id, ip from rs), j as (select coalesce(dt.session_id, t.session_id) as session_id, dt.ip as di, t.ip as ti from dt full join t on dt.session_id = t.session_id and dt.ip = t.ip),
  g as (select session_id, count(di) as n_detected, count(ti) as n_truth, count(*) filter (di is not null and ti is not null) as tp from j group by all)
  select *, round(tp / n_detected, 6) as precision, round(tp / n_truth, 6) as recall, round(2 * (tp / n_detected) * (tp / n_truth) / (tp / n_detected + tp / n_truth), 6) as f1 from g""")
def _(spark, d):
    p, *_, r = _candidates(spark, d)
    return V.prf(r.select("session_id", "ip"), p.where("arp_psrc is not null").select("session_id", F.col("arp_psrc").alias("ip")))


_ALL = "(values " + ", ".join(f"('{c}')" for c in V.CATEGORIES) + ")"


@C.add("q02_confusion", _LAB + f"select a.l as true_category, b.l as category, count(lab.doc_id) as n from {_ALL} a(l) cross join {_ALL} b(l) left join lab on lab.true_category = a.l and lab.category = b.l group by a.l, b.l")
def _(spark, d):
    return V.confusion(_lab(spark, d))


@C.add("q02_per_label_prf", _LAB + f""", g as (select l as label, (select count(*) from lab where true_category = l) as s, (select count(*) from lab where category = l) as p, (select count(*) from lab where category = l and true_category = l) as tp from {_ALL} a(l))
  select label, {rdd('case when p > 0 then tp / p else 0 end', 3)} as precision, {rdd('tp / s', 3)} as recall, {rdd('2 * tp / (p + s)', 3)} as f1, s as support from g where s > 0""")
def _(spark, d):
    return V.per_label_prf(_lab(spark, d))


def _kappa_sql(w):
    return _LAB + f""", m as (select list_position({list(V.CATEGORIES)!r}, true_category) as i, list_position({list(V.CATEGORIES)!r}, category) as j, count(*) as n from lab group by all),
  r as (select i, sum(n) as n from m group by all), c as (select j, sum(n) as n from m group by all)
  select (select cast(sum(n) as bigint) from m) as n, {rdd(f"1 - (select sum(n * {w}) from m) / ((select sum(r.n * c.n * {w}) from r, c) / (select sum(n) from m))", 4)} as kappa"""


@C.add("q03_cohen_kappa", _kappa_sql("(case when i = j then 0 else 1 end)"))
def _(spark, d):
    return V.cohen_kappa(_lab(spark, d))


@C.add("q03_cohen_kappa_linear", _kappa_sql("abs(i - j)"))
def _(spark, d):
    return V.cohen_kappa(_lab(spark, d), weights="linear")


@C.add("q04_expectation_checks", _SC + """, ob(session_id, "check", observed) as (select session_id, 'scan_SYN', count(*)::double from scan where type = 'SYN' group by all union all select session_id, 'amp', count(*)::double from amp group by all union all select session_id, 'arp', count(*)::double from arpc group by all),
  ex as (select session_id, "check", mode, bound from (values ('S1'), ('S2')) s(session_id), (values ('scan_SYN', 'at_least', 1.0::double), ('amp', 'equal', 8.0::double), ('arp', 'at_most', 0.0::double), ('dga', 'at_most', 0.0::double)) e("check", mode, bound))
  select ex.session_id, ex."check", mode, bound, coalesce(observed, 0.0) as observed, case mode when 'equal' then coalesce(observed, 0) = bound when 'at_most' then coalesce(observed, 0) <= bound else coalesce(observed, 0) >= bound end as passed from ex left join ob on ob.session_id = ex.session_id and ob."check" = ex."check" """)
def _(spark, d):
    _, _, scan, amp, arp, _ = _candidates(spark, d)
    n = lambda df, c: df.groupBy("session_id").agg(F.count("*").cast("double").alias("observed")).withColumn("check", F.lit(c))
    ob = n(scan.where("type = 'SYN'"), "scan_SYN").unionByName(n(amp, "amp")).unionByName(n(arp.select("session_id", "ip").distinct(), "arp"))
    ex = spark.createDataFrame([(s, *r) for s in ("S1", "S2") for r in (("scan_SYN", "at_least", 1.0), ("amp", "equal", 8.0), ("arp", "at_most", 0.0), ("dga", "at_most", 0.0))],
                               "session_id string, check string, mode string, bound double")
    return V.expectation_checks(ob, ex)


@C.add("q05_judge_benchmark", VOTES + f""", b as (select model, case when seat % 2 = 0 then 'attack' else 'benign' end as tk, coalesce(verdict = initial_verdict, false) as c, coalesce(verdict <> 'benign', false) as vc, revised as ga, initial_verdict as mv, error, latency_ms from votes),
  g as (select model, count(*) as fixtures, count(error) as dropped, {rdd('count(*) filter (c) / count(*)', 3)} as category_accuracy, case when count(*) filter (tk = 'attack') > 0 then {rdd("count(*) filter (tk = 'attack' and vc) / greatest(count(*) filter (tk = 'attack'), 1)", 3)} end as detection_rate,
    case when count(*) filter (tk = 'benign') > 0 then {rdd("count(*) filter (tk = 'benign' and vc) / greatest(count(*) filter (tk = 'benign'), 1)", 3)} end as benign_accuracy, count(*) filter (tk = 'attack' and ga and vc and mv = 'benign') as guardrail_saves, cast(floor(avg(latency_ms)) as bigint) as latency_ms_mean,
    cast(floor(quantile_cont(latency_ms::double, 0.5)) as bigint) as latency_ms_median from b group by model)
  select *, case when dropped * 3 >= fixtures then 'NOT USABLE' when detection_rate >= 1 and category_accuracy >= 0.8 then 'GOOD' when detection_rate >= 1 then 'ACCEPTABLE' else 'WEAK' end as qualification from g""")
def _(spark, d):
    v = votes(spark, d).selectExpr("model", "case when seat % 2 = 0 then 'attack' else 'benign' end as truth_kind", "verdict = initial_verdict as correct", "verdict <> 'benign' as verdict_correct",
                                   "revised as guardrail_applied", "initial_verdict as model_verdict", "error", "latency_ms")
    return V.judge_benchmark(v)


@C.add("j18_align_truth", VOTES + """, r as (select session_id, case when seat = 0 and conv_id < 2 then 'session' else 'ip' end as kind, ip as candidate_id, category from votes)
  select session_id, kind, candidate_id, category, case when session_id = 'S2' then 'syn_flood' when candidate_id like '10.0.2.%' then 'dns_amp' else 'benign_anomaly' end as true_category,
  case when session_id = 'S2' or candidate_id like '10.0.2.%' then 'malicious' else 'benign' end as true_verdict from r where case when session_id = 'S2' then kind = 'session' else kind = 'ip' end""")
def _(spark, d):
    r = votes(spark, d).selectExpr("session_id", "case when seat = 0 and conv_id < 2 then 'session' else 'ip' end as kind", "ip as candidate_id", "category")
    t = r.where("session_id = 'S1' and candidate_id like '10.0.2.%'").selectExpr("session_id", "candidate_id as ip", "'dns_amp' as category", "false as is_flood").unionByName(
        r.where("session_id = 'S2'").selectExpr("session_id", "cast(null as string) as ip", "'syn_flood' as category", "true as is_flood").distinct())
    return V.align_truth(r, t)


@C.add("j19_locate_access_points", W + """, pl as (select 'aa:bb:cc:00:00:0' || i as bssid, 32.0 + i as lat, 34.0 + i as lon from range(0, 3) t(i)) select lower(wlan_bssid) as bssid, lat::double as lat, lon::double as lon, count(*) as n from packets join pl on bssid = lower(wlan_bssid) group by all""")
def _(spark, d):
    places = spark.createDataFrame([(f"AA:BB:CC:00:00:0{i}", 32.0 + i, 34.0 + i, None) for i in range(3)] + [("AA:BB:CC:00:00:03", None, None, None)], "bssid string, lat double, lon double, ssid string")
    pts = packets(spark, d).where("wlan_bssid is not null").select(F.col("wlan_bssid").alias("bssid"), F.col("wlan_ssid").alias("ssid"))
    return V.locate_access_points(pts, places).groupBy("bssid", "lat", "lon").agg(F.count("*").alias("n"))


# ---- retrieval --------------------------------------------------------------------------------

@C.add("p24_x01_index_chunks")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source"), "text")
    return X.index_chunks(docs).select("source", "ord", "text", "content_hash")


@C.add("x02_dedup_chunks", """with c as (select doc_id, lang as source, text, sha256(lang || '|' || text) as h, doc_id % 4 = 0 as stored from documents)
  select h as content_hash, min(doc_id) as "ord" from c where not stored and h not in (select h from c where stored) group by h""")
def _(spark, d):
    from packetloom.functions import content_hash
    c = table(spark, d, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("ord"), "text", content_hash(F.col("lang"), F.col("text")).alias("content_hash"))
    return X.dedup_chunks(c.where("ord % 4 <> 0"), c.where("ord % 4 = 0")).select("content_hash", "ord")


@C.add("a26_index_stats", """select lang as kind, count(*) as chunks, count(distinct source) as sources from documents group by all union all select '*', count(*), count(distinct source) from documents""")
def _(spark, d):
    return X.index_stats(table(spark, d, "documents").select("source", F.create_map(F.lit("kind"), F.col("lang")).alias("meta")))


_NV = "list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))"


@C.add("x03_l2_normalize", f"with n as (select vec_id, {_NV} as v from embeddings) select vec_id, {rd('v[1]')} as first_value, {rd('list_sum(v)')} as total, {rd('list_sum(list_transform(v, lambda x: x * x))')} as norm from n")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", X.l2_normalize(F.col("embedding")).alias("v"))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.col("v")[0].alias("first_value"), total(F.col("v")).alias("total"), total(F.transform("v", lambda x: x * x)).alias("norm"))


@C.add("x04_cosine_topk", f"""with n as (select vec_id, label, {_NV} as v from embeddings), s as (select q.vec_id as query_id, c.vec_id as chunk_id, list_sum(list_transform(range(1, 65), lambda i: q.v[i] * c.v[i])) as score from n q, n c)
  select query_id, chunk_id, {rd('score')} as score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 6""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return X.cosine_topk(q, c).select("query_id", "chunk_id", "score", "rank")
