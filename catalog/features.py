"""Features, counters, scans and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import (
    content_hash, classify_domain, coalesce_ip, device_name, distance_bucket, is_local_scope, is_private,
    is_public, is_random_mac, is_tcp_start, json_path_exists, leftmost_label, oui_prefix, registrable_domain,
    registrable_simple, rssi_distance_m, shannon_entropy, subnet24, tcp_flag_class, tcp_flag_int, ti_reasons,
    ti_score, time_context, tls_version_label, upload_ratio, verdict_cache_key, vowel_ratio, weak_cipher,
    weak_tls_version,
)
from packetloom.operators import features as A
from packetloom.sources import adapters

from .base import (
    FEATURES_SQL, FLAGGED_SQL, FLOWS_SQL, PACKETS_SQL, RAW_SQL, Catalog, flows, local_scope_sql, packets,
    private_sql, rd, rdd, table,
)

C = Catalog()

W = f"with {PACKETS_SQL} "
WF = f"with {FEATURES_SQL} "

# ---- scans ------------------------------------------------------------------------------------

_COLS = ("packet_id, session_id, ts, len, ip_src, ip_dst, proto, tcp_sport, tcp_dport, udp_sport, udp_dport, "
         "tcp_flags, dns_qname, dns_response, arp_psrc, tls_sni")


@C.add("s02_normalize_packets", W + f"select {_COLS.replace(' ts,', ' round(ts, 6) as ts,')} from packets")
def _(spark, d):
    return packets(spark, d).selectExpr(*_COLS.split(", "))


@C.add("s03_column_pruned_aggregate", f"with {FLOWS_SQL} select session_id, count(*) as rows, cast(sum(len) as bigint) as bytes, "
       f"{rd('avg(len)')} as mean_len, {rd('stddev_samp(len)')} as std_len from flows group by session_id")
def _(spark, d):
    return flows(spark, d).groupBy("session_id").agg(
        F.count("*").alias("rows"), F.sum("len").alias("bytes"), F.avg("len").alias("mean_len"),
        F.coalesce(F.stddev_samp("len"), F.lit(0.0)).alias("std_len"))


# ---- scalars ----------------------------------------------------------------------------------

@C.add("p01_tcp_flag_int", f"with {FLAGGED_SQL} select tcp_flags, fi, count(*) as n from flagged group by all")
def _(spark, d):
    return packets(spark, d).groupBy("tcp_flags", tcp_flag_int(F.col("tcp_flags")).alias("fi")).agg(F.count("*").alias("n"))


@C.add("p02_tcp_flag_class", f"""with {FLAGGED_SQL} select packet_id, fi & 63 = 2 as syn, fi & 63 = 1 as fin, fi & 63 = 0 as "null",
  fi & 63 = 41 as xmas, fi & 4 <> 0 as rst from flagged where tcp_flags is not null""")
def _(spark, d):
    p = packets(spark, d).where("tcp_flags is not null")
    return p.select("packet_id", *[tcp_flag_class(F.col("tcp_flags"), c).alias(c)
                                   for c in ("syn", "fin", "null", "xmas", "rst")])


@C.add("p03_is_tcp_start", W + "select packet_id, tcp_flags from packets where proto = 'TCP' and tcp_flags in ('0x02', '0x0002', '0x00000002', '2')")
def _(spark, d):
    return packets(spark, d).where(is_tcp_start(F.col("proto"), F.col("tcp_flags"))).select("packet_id", "tcp_flags")


@C.add("p04_coalesce_ip", f"with {RAW_SQL} select packet_id, coalesce(nullif(ip_src, ''), nullif(ip6_src, '')) as ip from raw")
def _(spark, d):
    r = adapters.raw_packets_from_events(spark, d)
    return r.select("packet_id", coalesce_ip(F.nullif("ip_src", F.lit("")), F.nullif("ip6_src", F.lit(""))).alias("ip"))


_IPS_SQL = W + ", ips as (select distinct unnest([ip_src, ip_dst, arp_psrc, '100.64.3.' || cast(packet_id % 200 as varchar), '172.' || cast(packet_id % 40 as varchar) || '.0.1', cast(224 + packet_id % 30 as varchar) || '.1.1.1', '192.0.0.' || cast(packet_id % 20 as varchar), 'not-an-ip']) as ip from packets) "


def _ips(spark, d):
    p = packets(spark, d)
    n = lambda e: F.expr(f"cast({e} as string)")
    return p.select(F.explode(F.array(
        "ip_src", "ip_dst", "arp_psrc", F.concat(F.lit("100.64.3."), n("packet_id % 200")),
        F.concat(F.lit("172."), n("packet_id % 40"), F.lit(".0.1")), F.concat(n("224 + packet_id % 30"), F.lit(".1.1.1")),
        F.concat(F.lit("192.0.0."), n("packet_id % 20")), F.lit("not-an-ip"))).alias("ip")).distinct()


@C.add("p05_is_private", _IPS_SQL + f"select ip, {private_sql('ip')} as private from ips where ip is not null")
def _(spark, d):
    return _ips(spark, d).where("ip is not null").select("ip", is_private(F.col("ip")).alias("private"))


@C.add("p06_is_local_scope_and_public", _IPS_SQL + f"""select ip, {local_scope_sql('ip')} as local_scope,
  ip <> 'not-an-ip' and not {private_sql('ip')} and not starts_with(ip, '100.64.') as public from ips where ip is not null""")
def _(spark, d):
    return _ips(spark, d).where("ip is not null").select(
        "ip", is_local_scope(F.col("ip")).alias("local_scope"), is_public(F.col("ip")).alias("public"))


NAMES_SQL = W + """, names as (select distinct dns_qname as name from packets where dns_qname is not null
  union select distinct split_part(split_part(url, '//', 2), '/', 1) from pages) """


def names(spark, d):
    host = F.split(F.split(F.col("url"), "//")[1], "/")[0]
    return (packets(spark, d).where("dns_qname is not null").select(F.col("dns_qname").alias("name")).distinct()
            .union(table(spark, d, "pages").select(host.alias("name")).distinct()).distinct())


_SLD = ("'co.uk','org.uk','ac.uk','gov.uk','co.il','org.il','ac.il','net.il','gov.il','com.au','net.au','org.au',"
        "'co.jp','com.br','co.in','com.cn','co.kr','co.za'")
REG_SQL = ("(case when len(string_split({0}, '.')) < 2 then {0} when array_to_string(string_split({0}, '.')[-2:], '.') in (" + _SLD + ") "
           "then array_to_string(string_split({0}, '.')[-3:], '.') else array_to_string(string_split({0}, '.')[-2:], '.') end)")


def reg_sql(col):
    return REG_SQL.format(f"lower(trim({col}, '.'))")


@C.add("p07_registrable_domain", NAMES_SQL + f"select name, {reg_sql('name')} as reg from names")
def _(spark, d):
    return names(spark, d).select("name", registrable_domain(F.col("name")).alias("reg"))


@C.add("p08_registrable_simple", NAMES_SQL + "select name, array_to_string(string_split(name, '.')[-2:], '.') as reg from names")
def _(spark, d):
    return names(spark, d).select("name", registrable_simple(F.col("name")).alias("reg"))


@C.add("p09_leftmost_label", NAMES_SQL + "select name, split_part(trim(name, '.'), '.', 1) as label from names")
def _(spark, d):
    return names(spark, d).select("name", leftmost_label(F.col("name")).alias("label"))


@C.add("p10_shannon_entropy", NAMES_SQL + f""", ch as (select name, unnest(string_split(name, '')) as c from names),
  cc as (select name, c, count(*) as n, sum(count(*)) over (partition by name) as t from ch where c <> '' group by name, c)
  select name, {rd('-sum(n / t * log2(n / t))')} as entropy from cc group by name""")
def _(spark, d):
    return names(spark, d).where("name <> ''").select("name", shannon_entropy(F.col("name")).alias("entropy"))


@C.add("p11_vowel_ratio", NAMES_SQL + f"select name, {rd('length(regexp_replace(lower(name), $$[^aeiou]$$, $$$$, $$g$$)) / length(name)')} as vowels from names")
def _(spark, d):
    return names(spark, d).select("name", vowel_ratio(F.col("name")).alias("vowels"))


@C.add("p16_classify_domain", NAMES_SQL + """select name, case
  when regexp_matches(lower(name), 'netflix|youtube|spotify|twitch|hulu|disneyplus|vimeo|soundcloud|tidal') then 'Streaming'
  when regexp_matches(lower(name), 'service-now|sas[.]com|salesforce|slack|zoom|teams[.]microsoft|office365|sharepoint|confluence|jira|workday|okta') then 'Work/Enterprise'
  when regexp_matches(lower(name), 'google|gmail|gstatic|gvt[12]|ggpht') then 'Google/Cloud'
  when regexp_matches(lower(name), 'amazonaws|azure|cloudfront|akamai|fastly|cloudflare|digitalocean|heroku') then 'Cloud Infra'
  when regexp_matches(lower(name), 'facebook|instagram|twitter|tiktok|linkedin|pinterest|reddit|snapchat') then 'Social'
  when regexp_matches(lower(name), 'ocsp|crl|certificate|update|telemetry|safebrowsing|malware|avast|norton|microsoft[.]com') then 'Security/Update'
  when regexp_matches(lower(name), 'bbc|cnn|nytimes|reuters|apnews|theguardian|ynet|haaretz|maariv|walla|n12|kan[.]org') then 'News/Media'
  when regexp_matches(lower(name), 'cdn|static|edge|cache|d[0-9a-z]+[.]net|doubleclick|2mdn|chartbeat') then 'CDN/Infra'
  else 'Other' end as category from names""")
def _(spark, d):
    return names(spark, d).select("name", classify_domain(F.col("name")).alias("category"))


@C.add("p17_mac_prefix_and_random_bit", W + """select distinct eth_src as mac, substr(upper(replace(eth_src, ':', '')), 1, 6) as prefix,
  substr(eth_src, 2, 1) in ('2', '3', '6', '7', 'a', 'b', 'e', 'f') as random from packets where eth_src is not null""")
def _(spark, d):
    m = F.col("mac")
    return (packets(spark, d).where("eth_src is not null").select(F.col("eth_src").alias("mac")).distinct()
            .select("mac", oui_prefix(m).alias("prefix"), is_random_mac(m).alias("random")))


@C.add("p18_device_name", W + """, n as (select distinct packet_id, ip_src, case k when 0 then ['_x.local', 'My Mac.local.'] when 1 then ['ab.local', 'lamp._hue._tcp.local']
  when 2 then ['local.local'] else [] end as m from (select packet_id, ip_src, packet_id % 4 as k from packets where ip_src is not null))
  select packet_id, case packet_id % 4 when 0 then 'My Mac' when 1 then 'lamp' when 2 then 'local' else
  'Web-client-' || case when ip_src like '%.%' then split_part(ip_src, '.', 4) else '?' end end as device from n""")
def _(spark, d):
    k = F.expr("packet_id % 4")
    arr = (F.when(k == 0, F.array(F.lit("_x.local"), F.lit("My Mac.local.")))
           .when(k == 1, F.array(F.lit("ab.local"), F.lit("lamp._hue._tcp.local")))
           .when(k == 2, F.array(F.lit("local.local"))).otherwise(F.array().cast("array<string>")))
    return packets(spark, d).where("ip_src is not null").select(
        "packet_id", device_name(F.col("ip_src"), arr, F.lit("Web client (likely phone)")).alias("device"))


@C.add("p19_rssi_distance", W + f"""select packet_id, {rd("case when r is not null then greatest(0.1, pow(10.0, (20.0 - r - 40.0) / 25.0)) end")} as metres
  from (select packet_id, try_cast(split_part(rssi_radiotap, ',', 1) as double) as r from packets where wlan_sa is not null)""")
def _(spark, d):
    r = F.split("rssi_radiotap", ",")[0].try_cast("double")
    return packets(spark, d).where("wlan_sa is not null").select("packet_id", rssi_distance_m(r).alias("metres"))


@C.add("p20_distance_bucket", W + """select packet_id, case when m is null then 'Unknown' when m < 2 then 'Same desk (< 2m)' when m < 5 then 'Same room (2-5m)'
  when m < 15 then 'Adjacent room (5-15m)' else 'Far / different floor (> 15m)' end as bucket
  from (select packet_id, greatest(0.1, pow(10.0, (-20.0 - try_cast(split_part(rssi_radiotap, ',', 1) as double)) / 25.0)) as m, rssi_radiotap from packets where wlan_sa is not null and rssi_radiotap is not null)""")
def _(spark, d):
    r = F.split("rssi_radiotap", ",")[0].try_cast("double")
    return packets(spark, d).where("wlan_sa is not null and rssi_radiotap is not null").select(
        "packet_id", distance_bucket(rssi_distance_m(r)).alias("bucket"))


_TLSL = ("case tls_version when '0x0300' then 'SSLv3' when '0x0301' then 'TLS 1.0' when '0x0302' then 'TLS 1.1' "
         "when '0x0303' then 'TLS 1.2' when '0x0304' then 'TLS 1.3' else tls_version end")


@C.add("p21_tls_version_label", W + f"""select tls_version, {_TLSL} as label, coalesce(tls_version in ('0x0300', '0x0301', '0x0302'), false) as weak,
  count(*) as n from packets group by all""")
def _(spark, d):
    v = F.col("tls_version")
    return packets(spark, d).groupBy("tls_version", tls_version_label(v).alias("label"),
                                     weak_tls_version(v).alias("weak")).agg(F.count("*").alias("n"))


@C.add("p22_weak_cipher", W + """select tls_cipher, coalesce(lower(tls_cipher) in ('0x0001','0x0002','0x0003','0x0004','0x0005','0x0006','0x0008','0x0009','0x000a'), false) as weak,
  count(*) as n from packets group by all""")
def _(spark, d):
    c = F.col("tls_cipher")
    return packets(spark, d).groupBy("tls_cipher", weak_cipher(c).alias("weak")).agg(F.count("*").alias("n"))


@C.add("p25_content_hash", "select doc_id, sha256(source || '|' || text) as content_hash from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@C.add("p26_verdict_cache_key", "select conv_id, turn, sha256(text || 'v0.6.1' || role) as cache_key from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", verdict_cache_key(F.col("text"), F.lit("v0.6.1"), F.col("role")).alias("cache_key"))


_TI = """select o_orderkey as key, o_orderkey % 5 as v, case o_orderkey % 3 when 0 then ['Tor', 'cloud'] when 1 then ['cdn'] else ['vpn', 'c2'] end as tags,
  o_custkey % 14 as p from orders"""


@C.add("p27_ti_score", f"""select key, {rdd("least(least(v * 0.2, 0.6) + case when tags[1] = 'cdn' then 0.0 else 0.4 end + case when p > 10 then 0.15 else 0.0 end, 1.0)", 4)} as score,
  array_to_string(list_filter([case when v > 0 then cast(v as varchar) || ' known CVE(s): ' || array_to_string(list_transform(range(1, v + 1), lambda x: 'CVE-' || x), ', ') end,
    case tags[1] when 'Tor' then 'tags: tor' when 'vpn' then 'tags: c2, vpn' end, case when p > 10 then p || ' exposed ports' end], lambda x: x is not null), '; ') as reasons
  from ({_TI})""")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr(
        "o_orderkey as key", "case when o_orderkey % 5 > 0 then transform(sequence(1, o_orderkey % 5), x -> concat('CVE-', x)) else array() end as vulns",
        "case o_orderkey % 3 when 0 then array('Tor', 'cloud') when 1 then array('cdn') else array('vpn', 'c2') end as tags",
        "case when o_custkey % 14 > 0 then sequence(1, o_custkey % 14) else array() end as ports")
    a = [F.col("vulns"), F.col("tags"), F.col("ports")]
    return o.select("key", ti_score(*a).alias("score"), F.array_join(ti_reasons(*a), "; ").alias("reasons"))


@C.add("p28_time_context", W + """select packet_id, strftime(make_timestamp(cast(floor(ts) as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S') as iso_timestamp,
  hour(make_timestamp(cast(floor(ts) as bigint) * 1000000)) as hour_of_day, strftime(make_timestamp(cast(floor(ts) as bigint) * 1000000), '%a') as day_of_week from packets""")
def _(spark, d):
    return packets(spark, d).select("packet_id", time_context(F.col("ts")).alias("t")).select("packet_id", "t.*")


@C.add("p29_json_path_exists", """select event_id, event_id % 3 <> 2 as found from events""")
def _(spark, d):
    doc = F.concat(F.lit('{"a": {"b": [1, '), F.regexp_extract("props", "([0-9]+)", 1), F.lit(', null]}, "props": '), F.col("props"), F.lit("}"))
    path = F.expr("case event_id % 3 when 0 then 'a.b[1]' when 1 then 'props.k' else case event_id % 2 when 0 then 'a.b[2]' else 'a.c.d' end end")
    return table(spark, d, "events").select("event_id", json_path_exists(doc, path).alias("found"))


_BYTES = W + """, io as (select session_id, ip, cast(sum(o) as bigint) as bytes_out, cast(sum(i) as bigint) as bytes_in from (
  select session_id, ip_src as ip, len as o, 0 as i from packets where ip_src is not null
  union all select session_id, ip_dst, 0, len from packets where ip_dst is not null) group by all) """


@C.add("p30_upload_ratio", _BYTES + f"select session_id, ip, case when bytes_in + bytes_out > 0 then {rdd('bytes_out / (bytes_in + bytes_out)', 3)} end as ratio from io")
def _(spark, d):
    t = A.traffic_totals(packets(spark, d)).where("dimension in ('src', 'dst')")
    io = t.groupBy("session_id", F.col("key").alias("ip")).agg(
        F.coalesce(F.sum(F.expr("case when dimension = 'src' then bytes end")), F.lit(0)).alias("o"),
        F.coalesce(F.sum(F.expr("case when dimension = 'dst' then bytes end")), F.lit(0)).alias("i"))
    return io.select("session_id", "ip", upload_ratio(F.col("i"), F.col("o")).alias("ratio"))


@C.add("p31_subnet24", W + "select array_to_string(string_split(ip_src, '.')[1:3], '.') as subnet, count(*) as n from packets where ip_src like '%.%' group by all")
def _(spark, d):
    return packets(spark, d).where("ip_src like '%.%'").groupBy(subnet24(F.col("ip_src")).alias("subnet")).agg(F.count("*").alias("n"))


# ---- per-host features ------------------------------------------------------------------------

_FCOLS = ("session_id, ip, \"count\", total_bytes, " + ", ".join(f"{rd(c)} as {c}" for c in ("mean_len", "std_len", "burst_score", "dominance"))
          + ", unique_dsts, syn_count, rst_count, fin_count, null_count, xmas_count")


@C.add("a01_ip_features", WF + f"select {_FCOLS} from features")
def _(spark, d):
    return A.ip_features(packets(spark, d))


@C.add("a01_ip_features_volume", f"with {FLOWS_SQL} select {_FCOLS} from flow_features")
def _(spark, d):
    return A.ip_features(flows(spark, d))


@C.add("a02_flag_counters", WF + "select * from flagcnt")
def _(spark, d):
    return A.flag_counters(packets(spark, d))


@C.add("j01_attach_counters", WF + "select session_id, ip, \"count\", syn_count, rst_count, fin_count, null_count, xmas_count from features")
def _(spark, d):
    p = packets(spark, d)
    return A.attach_counters(A.ip_features(p).select("session_id", "ip", "count"), A.flag_counters(p))


@C.add("a03_traffic_totals", W + """select session_id, dimension, key, key2, count(*) as packets, cast(sum(len) as bigint) as bytes from (
  select session_id, len, 'src' as dimension, ip_src as key, null as key2 from packets union all
  select session_id, len, 'dst', ip_dst, null from packets union all select session_id, len, 'proto', proto, null from packets union all
  select session_id, len, 'mac', eth_src, null from packets union all
  select session_id, len, 'pair', ip_src, ip_dst from packets where ip_src is not null and ip_dst is not null) where key is not null group by all""")
def _(spark, d):
    return A.traffic_totals(packets(spark, d))


@C.add("a04_session_summary", W + f""", pr as (select session_id, proto, count(*) as n, row_number() over (partition by session_id order by count(*) desc, proto) as r
  from packets where proto is not null group by session_id, proto), tp as (select session_id, string_agg(proto || ':' || n, ';' order by r) as top_protocols from pr where r <= 5 group by all),
  b as (select session_id, count(*) as n_pkts, {rd('min(ts)')} as t0, {rd('max(ts)')} as t1, {rd('max(ts) - min(ts)')} as duration_s, count(distinct ip_src) as n_src_ips,
  count(distinct eth_src) as n_macs from packets group by all) select * from b left join tp using (session_id)""")
def _(spark, d):
    return A.session_summary(packets(spark, d))


ARP_SQL = W + """, claims as (select distinct session_id, arp_psrc as ip, arp_hwsrc as mac from packets
  where arp_psrc is not null and arp_hwsrc is not null and arp_psrc <> '0.0.0.0') """


@C.add("a05_arp_claims", ARP_SQL + """select * from (select session_id, 'ip' as side, ip as key, mac as member, count(*) over (partition by session_id, ip) as members from claims
  union all select session_id, 'mac', mac, ip, count(*) over (partition by session_id, mac) from claims) where members > 1""")
def _(spark, d):
    return A.arp_claims(packets(spark, d))


@C.add("a06_dns_response_sizes", W + f"""select session_id, ip_src as ip, count(*) as responses, cast(sum(len) as bigint) as total_bytes, {rd('avg(len)')} as mean_size
  from packets where dns_response = '1' and udp_sport = 53 and ip_src is not null group by all""")
def _(spark, d):
    return A.dns_response_sizes(packets(spark, d))


_Q = W + ", q as (select *, rtrim(dns_qname, '.') as qname from packets where length(dns_qname) > 3 and length(rtrim(dns_qname, '.')) > 3) "


@C.add("a07_dns_query_counts", _Q + "select session_id, qname, count(*) as n from q group by all")
def _(spark, d):
    return A.dns_query_counts(packets(spark, d))


@C.add("p13_long_queries", _Q + "select distinct session_id, qname from q where length(qname) > 60")
def _(spark, d):
    return A.dns_long_queries(packets(spark, d))


REAL_SQL = "contains(qname, '.') and not ends_with(qname, '.local') and not regexp_matches(split_part(qname, '.', 1), '(?i)^_|^wpad$|^KMD|^BRW|^v1$|^server|^HP$')"


@C.add("p14_real_dns", _Q + f"select session_id, qname, count(*) as n from q where {REAL_SQL} group by all")
def _(spark, d):
    return A.real_dns_counts(packets(spark, d))


@C.add("p15_mdns_device_names", _Q + """select distinct session_id, qname from q where ends_with(qname, '.local') and not starts_with(qname, '_')
  and not regexp_matches(qname, '^[0-9a-f-]{8,}') and length(qname) > 8""")
def _(spark, d):
    return A.mdns_device_names(packets(spark, d))


@C.add("a08_nxdomain_stats", W + "select session_id, ip_dst as ip, count(*) as nxdomain from packets where dns_rcode = '3' and dns_response = '1' group by all")
def _(spark, d):
    return A.nxdomain_stats(packets(spark, d))


@C.add("a09_dns_nonstandard_ports", W + """select session_id, count(*) filter (udp_dport not in (53, 5353)) as nonstandard from packets
  where dns_qname is not null and udp_dport is not null and dns_response <> '1' group by all""")
def _(spark, d):
    return A.dns_nonstandard_ports(packets(spark, d))


@C.add("a10_client_queries_per_ip", W + """select session_id, ip_src as ip, rtrim(dns_qname, '.') as qname, count(*) as n from packets
  where dns_qname is not null and ip_src is not null and dns_response <> '1' and rtrim(dns_qname, '.') <> '' group by all""")
def _(spark, d):
    return A.client_queries_per_ip(packets(spark, d))


@C.add("a11_dst_ports_per_ip", W + """select session_id, ip, port_proto, count(*) as n from (select session_id, ip_src as ip, tcp_dport || '/tcp' as port_proto from packets
  union all select session_id, ip_src, udp_dport || '/udp' from packets) where ip is not null and port_proto is not null group by all""")
def _(spark, d):
    return A.dst_ports_per_ip(packets(spark, d))


@C.add("a12_http_hosts_per_ip", W + "select session_id, ip_src as ip, http_host as host, count(*) as n from packets where ip_src is not null and http_host is not null group by all")
def _(spark, d):
    return A.http_hosts_per_ip(packets(spark, d))


@C.add("a12_tls_sni_per_ip", W + "select session_id, ip_src as ip, tls_sni as host, count(*) as n from packets where ip_src is not null and tls_sni is not null group by all")
def _(spark, d):
    return A.tls_sni_per_ip(packets(spark, d))


MACS_SQL = W + """, macs as (select session_id, ip_src as ip, eth_src as mac, count(*) as n from packets where ip_src is not null and eth_src is not null group by all),
  dom as (select * from macs qualify row_number() over (partition by session_id, ip order by n desc, mac) = 1) """


@C.add("a13_ip_mac_counts", MACS_SQL + "select * from macs")
def _(spark, d):
    return A.ip_mac_counts(packets(spark, d))


@C.add("a13_dominant_mac", MACS_SQL + "select * from dom")
def _(spark, d):
    return A.dominant_mac(packets(spark, d))


PORTS_SQL = W + """, ports as (select distinct session_id, ip, port from (select session_id, ip_src as ip, unnest([tcp_sport, tcp_dport, udp_sport, udp_dport]) as port
  from packets where ip_src is not null) where port is not null) """


@C.add("a14_ports_per_ip", PORTS_SQL + "select session_id, ip, count(*) as n_ports from ports group by all")
def _(spark, d):
    return A.ports_per_ip(packets(spark, d))


@C.add("a15_mdns_names", _Q + "select distinct session_id, ip_src as ip, qname as name from q where ends_with(qname, '.local') and ip_src is not null")
def _(spark, d):
    return A.ip_mdns_names(packets(spark, d))


@C.add("a15_mdns_names_per_ip", _Q + """select session_id, ip_src as ip, string_agg(distinct qname, ';' order by qname) as names, count(distinct qname) as n_names from q
  where ip_src is not null and ends_with(qname, '.local') group by all""")
def _(spark, d):
    return A.mdns_names_per_ip(packets(spark, d))


WLAN_SQL = W + """, wl as (select session_id, lower(wlan_sa) as mac, ts, cast(wlan_type as bigint) as t, cast(wlan_subtype as bigint) as s, cast(wlan_retry as bigint) as r,
  coalesce(try_cast(split_part(rssi_radiotap, ',', 1) as double), try_cast(split_part(rssi_wlanradio, ',', 1) as double)) as rssi from packets where wlan_sa is not null),
  wlan as (select session_id, mac, count(*) as frames, count(*) filter (t = 0 and s = 4) as probe_requests, count(*) filter (t = 0 and s between 0 and 3) as association_frames,
  count(*) filter (t = 0 and s in (10, 12)) as deauth_frames, count(*) filter (r = 1) as retries, count(rssi) as rssi_samples, avg(rssi) as mean_rssi,
  coalesce(stddev_pop(rssi), 0.0) as std_rssi, min(ts) as first_seen, max(ts) as last_seen,
  (select string_agg(kv, ';' order by kv) from (select lpad(cast(t as varchar), 4, '0') || ':' || count(*) as kv from wl x where x.session_id = wl.session_id and x.mac = wl.mac group by t)) as frame_types,
  (select string_agg(kv, ';' order by kv) from (select lpad(cast(s as varchar), 4, '0') || ':' || count(*) as kv from wl x where x.session_id = wl.session_id and x.mac = wl.mac group by s)) as subtypes
  from wl group by session_id, mac) """


@C.add("a16_wlan_features", WLAN_SQL + f"select * replace ({rd('mean_rssi')} as mean_rssi, {rd('std_rssi')} as std_rssi, {rd('first_seen')} as first_seen, {rd('last_seen')} as last_seen) from wlan")
def _(spark, d):
    return A.wlan_features(packets(spark, d))


@C.add("a17_dominant_ssid_bssid", W + """, f as (select session_id, lower(wlan_bssid) as b, wlan_ssid as s from packets where wlan_type = '0' and wlan_subtype in ('8', '5')),
  b as (select session_id, b, row_number() over (partition by session_id order by count(*) desc, b) as r from f where length(b) - length(replace(b, ':', '')) = 5 group by session_id, b),
  s as (select session_id, s, row_number() over (partition by session_id order by count(*) desc, s) as r from f where s is not null group by session_id, s)
  select coalesce(b.session_id, s.session_id) as session_id, b.b as bssid, s.s as ssid from (select * from b where r = 1) b full join (select * from s where r = 1) s using (session_id)""")
def _(spark, d):
    return A.dominant_ssid_bssid(packets(spark, d))


TLS_SUM_SQL = W + f""", tv as (select session_id, ip_src as ip, tls_version, {_TLSL} as label, tls_cipher from packets where ip_src is not null and tls_version is not null),
  tn as (select session_id, ip, tls_version, any_value(label) as label, count(*) as n, row_number() over (partition by session_id, ip order by count(*) desc, tls_version) as r from tv group by session_id, ip, tls_version),
  tsum as (select session_id, ip, count(*) filter (lower(tls_cipher) in ('0x0001','0x0002','0x0003','0x0004','0x0005','0x0006','0x0008','0x0009','0x000a')) as weak_cipher_count,
  bool_or(label in ('SSLv3', 'TLS 1.0', 'TLS 1.1')) as has_weak_version,
  (select string_agg(label || '=' || n, ';' order by r) from tn where r <= 5 and tn.session_id = tv.session_id and tn.ip = tv.ip) as versions from tv group by session_id, ip) """


@C.add("a18_tls_summary_by_ip", TLS_SUM_SQL + "select * from tsum")
def _(spark, d):
    t = A.tls_summary_by_ip(packets(spark, d))
    return t.withColumn("versions", F.expr("array_join(transform(versions, v -> concat(v.version, '=', v.count)), ';')"))


@C.add("k07_top_n_struct", W + """, c as (select session_id, ip_src as ip, rtrim(dns_qname, '.') as q, count(*) as n from packets where dns_response <> '1' and ip_src is not null and dns_qname is not null group by all),
  r as (select *, row_number() over (partition by session_id, ip order by n desc, q) as r from c where not ends_with(q, '.local') and not ends_with(q, '.arpa') and not starts_with(q, '_'))
  select session_id, ip, string_agg(q || '=' || n, ';' order by r) as top_dns_queries from r where r <= 5 group by all""")
def _(spark, d):
    t = A.top_n_struct(A.browsing_names(A.client_queries_per_ip(packets(spark, d))), "qname", "host", "top")
    return t.select("session_id", "ip", F.expr("array_join(transform(top, v -> concat(v.host, '=', v.count)), ';')").alias("top_dns_queries"))
