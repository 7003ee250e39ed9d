"""Rankings, comparison, device and provider inventory, browsing views."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import browsing as B, features as A, inventory as I, rankings as K, rules as D

from .base import FEATURES_SQL, FLOWS_SQL, Catalog, flows, packets, private_sql, rd
from .detection import HOST_SQL, PROVIDERS, by_ip_sql
from .features import MACS_SQL, REAL_SQL, W, WF, _BYTES, _Q

C = Catalog()
FF = f"with {FLOWS_SQL} "

# ---- rankings ---------------------------------------------------------------------------------


@C.add("k01_top_talkers", FF + f"select session_id, ip, {rd('dominance')} as dominance, total_bytes, row_number() over (partition by session_id order by dominance desc, ip) as rank from flow_features qualify rank <= 15")
def _(spark, d):
    return K.top_talkers(A.ip_features(flows(spark, d))).select("session_id", "ip", "dominance", "total_bytes", "rank")


@C.add("k02_top_protocols", W + "select session_id, proto, count(*) as n, row_number() over (partition by session_id order by count(*) desc, proto) as rank from packets where proto is not null group by session_id, proto qualify rank <= 10")
def _(spark, d):
    return K.top_protocols(packets(spark, d))


@C.add("k03_top_dns_services", _Q + f"""select session_id, qname, count(*) as n, row_number() over (partition by session_id order by count(*) desc, qname) as rank,
  case when starts_with(lower(qname), 'www.') then lower(qname) else 'www.' || lower(qname) end as display from q where {REAL_SQL} group by session_id, qname qualify rank <= 25""")
def _(spark, d):
    return K.top_dns_services(packets(spark, d))


@C.add("k04_top_n_plus_others", FF + """, r as (select session_id, ip, total_bytes as bytes, row_number() over (partition by session_id order by total_bytes desc, ip) as rank from flow_features)
  select session_id, ip, bytes, rank from r where rank <= 10 union all select session_id, 'Others (' || count(*) || ' IPs)', cast(sum(bytes) as bigint), 11 from r where rank > 10 group by session_id having sum(bytes) > 0""")
def _(spark, d):
    f = A.ip_features(flows(spark, d)).select("session_id", "ip", F.col("total_bytes").alias("bytes"))
    return K.top_n_plus_others(f, "ip", "bytes")


@C.add("k09_b04_bytes_per_minute", WF + """, t6 as (select session_id, ip from features qualify row_number() over (partition by session_id order by total_bytes desc, ip) <= 6),
  pr as (select * from packets where ip_src is not null and ip_dst is not null), z as (select session_id, min(ts) as t0 from pr group by all)
  select session_id, cast(floor((ts - t0) / 60) as bigint) as minute, ip_src as src, cast(sum(len) as bigint) as bytes from pr join z using (session_id)
  where (session_id, ip_src) in (select (session_id, ip) from t6) group by all""")
def _(spark, d):
    p = packets(spark, d)
    return K.top_sources_timeline(p, A.ip_features(p))


_CMP = W + """, sb as (select session_id, ip_src as ip, cast(sum(len) as bigint) as bytes from packets where ip_src is not null group by all),
  cmp as (select coalesce(a.ip, b.ip) as ip, coalesce(a.bytes, 0) as bytes_s1, coalesce(b.bytes, 0) as bytes_s2, coalesce(b.bytes, 0) - coalesce(a.bytes, 0) as change,
  case when a.ip is null then 'new' when b.ip is null then 'gone' else 'both' end as status from (select * from sb where session_id = 'S1') a full join (select * from sb where session_id = 'S2') b on a.ip = b.ip) """


def _cmp(spark, d):
    return K.session_compare(K.source_bytes(packets(spark, d)), "S1", "S2")


@C.add("j02_session_compare", _CMP + "select * from cmp")
def _(spark, d):
    return _cmp(spark, d)


@C.add("j02_churn_counts", _CMP + """select count(*) filter (status = 'new') as "new", count(*) filter (status = 'gone') as gone, count(*) filter (status = 'both') as "both" from cmp""")
def _(spark, d):
    return K.churn_counts(_cmp(spark, d))


@C.add("u02_session_sets", _CMP + "select ip, case status when 'both' then 'shared' else status end as part from cmp")
def _(spark, d):
    return K.session_sets(K.source_bytes(packets(spark, d)), "S1", "S2")


@C.add("k06_top_changes", _CMP + """, v as (select cmp.*, 'traffic' as view, bytes_s1 as weight from cmp where status = 'both' union all select cmp.*, 'change', abs(change) from cmp where status = 'both'
  union all select cmp.*, 'new', bytes_s2 from cmp where status = 'new' union all select cmp.*, 'gone', bytes_s1 from cmp where status = 'gone')
  select *, row_number() over (partition by view order by weight desc, ip) as rank from v qualify rank <= 15""")
def _(spark, d):
    return K.top_changes(_cmp(spark, d))


@C.add("k10_insights", _CMP.replace(W, WF) + f""", dl as (select ip from features where {private_sql('ip')} order by dominance desc, ip desc limit 1),
  ex as (select ip, bytes from sb where session_id = 'S2' and not {private_sql('ip')} order by bytes desc, ip desc limit 1),
  ar as (select count(*) as n from (select session_id, arp_psrc from packets where arp_psrc <> '0.0.0.0' and arp_hwsrc is not null group by all having count(distinct arp_hwsrc) > 1)),
  td as (select qname, count(*) as n from (select rtrim(dns_qname, '.') as qname from packets where session_id = 'S2' and length(dns_qname) > 3) where length(qname) > 3 and {REAL_SQL} group by all order by n desc, qname limit 3)
  select 1::bigint as ord, 'Dominant LOCAL node: ' || ip || format(' | S1={{:.1f}}MB · S2={{:.1f}}MB', coalesce((select bytes from sb where session_id = 'S1' and sb.ip = dl.ip), 0) / 1e6, coalesce((select bytes from sb where session_id = 'S2' and sb.ip = dl.ip), 0) / 1e6) as line from dl
  union all select 2, 'Largest external source (S2): ' || ip || format(' ({{:.1f}}MB)', bytes / 1e6) from ex
  union all select 3, case when n = 0 then 'ARP: CLEAN - no spoofing detected' else 'ARP: WARNING - ' || n || ' suspicious IP-MAC mappings' end from ar
  union all select 4, 'IP churn between sessions: ' || count(*) filter (status = 'gone') || ' gone, ' || count(*) filter (status = 'new') || ' new, ' || count(*) filter (status = 'both') || ' persistent' from cmp
  union all select 5, 'Top DNS services (S2): ' || string_agg(qname || ' (' || n || 'x)', ', ' order by n desc, qname) from td""".replace("{{", "{").replace("}}", "}"))
def _(spark, d):
    p = packets(spark, d)
    return K.insights(A.ip_features(p), K.source_bytes(p), D.arp_spoofing(p), A.real_dns_counts(p), "S1", "S2")


# ---- lookups ----------------------------------------------------------------------------------

OUI = (("3C5AB4", "Google, Inc."), ("A483E7", "Apple, Inc."), ("001B63", "Samsung Electronics"))
OUI_SQL = "oui(prefix6, vendor) as (values ('3C5AB4', 'Google, Inc.'), ('A483E7', 'Apple, Inc.'), ('001B63', 'Samsung Electronics'))"


def oui(spark):
    return spark.createDataFrame(OUI, "prefix6 string, vendor string")


@C.add("j03_vendor_lookup", MACS_SQL + f", {OUI_SQL} select session_id, ip, mac, coalesce(vendor, '') as vendor_oui from dom left join oui on substr(upper(replace(mac, ':', '')), 1, 6) = prefix6")
def _(spark, d):
    return I.vendor_lookup(A.dominant_mac(packets(spark, d)), oui(spark)).select("session_id", "ip", "mac", "vendor_oui")


@C.add("j04_cidr_provider", _BYTES + f", {by_ip_sql('io')} select * from matches")
def _(spark, d):
    return PROVIDERS.by_ip(I.address_bytes(packets(spark, d)))


@C.add("j05_host_provider", W + f", h as (select distinct tls_sni as host from packets where tls_sni is not null) select host, {HOST_SQL.format('host')} as provider from h where {HOST_SQL.format('host')} is not null")
def _(spark, d):
    return PROVIDERS.by_host(packets(spark, d).where("tls_sni is not null").select(F.col("tls_sni").alias("host"))).select("host", "provider")


_DN = _Q + """, dn as (select distinct session_id, qname, lower(replace(qname, '.local', '')) as base from q where ends_with(qname, '.local') and not starts_with(qname, '_')
  and not regexp_matches(qname, '^[0-9a-f-]{8,}') and length(qname) > 8), sip as (select session_id, ip_src as ip, cast(sum(len) as bigint) as bytes from packets where ip_src is not null group by all) """


@C.add("j09_name_devices", _DN + "select s.session_id, ip, max(qname) as name from sip s join dn on dn.session_id = s.session_id and contains(lower(ip), base) group by all")
def _(spark, d):
    p = packets(spark, d)
    return I.name_devices(K.source_bytes(p), A.mdns_device_names(p))


@C.add("k11_named_device_bytes", _DN + "select dn.session_id, qname as name, coalesce(cast(sum(bytes) as bigint), 0) as bytes from dn left join sip s on dn.session_id = s.session_id and contains(lower(ip), base) group by dn.session_id, qname")
def _(spark, d):
    p = packets(spark, d)
    return I.named_device_bytes(K.source_bytes(p), A.mdns_device_names(p))


# ---- classification ---------------------------------------------------------------------------

RULES = (I.DeviceRule("r-apple-ssh", 900, ("Computers", "Mac", "Apple", "Mac"), vendor_match="apple", ports_any=(22, 445)),
         I.DeviceRule("r-dev1", 600, ("Smart Home", "Lamp", "Acme", "Lamp"), mdns_regex=r"^device1[0-9]?\."),
         I.DeviceRule("r-skip", 999, ("x", "x", "x", "x"), mac_is_random=True),
         I.DeviceRule("r-netflix", 250, ("Entertainment", "TV", "Generic", "TV"), dns_regex="netflix", ports_any=(9100, 443)))
PRINTS = (I.DnsFingerprint("fp-social", ("facebook", "youtube.com", "slack"), ("Mobile", "Phone", "Generic", "Phone"), 2),
          I.DnsFingerprint("fp-cdn", (r"cdn\.|d111", "digicert", "bbc.co.uk", "facebook"), ("Computers", "PC", "Generic", "PC"), 2, "low"))
CONFIG = I.DeviceConfig(RULES, PRINTS)

_DEV = MACS_SQL + f""", {OUI_SQL}, pp as (select distinct session_id, ip, port from (select session_id, ip_src as ip, unnest([tcp_sport, tcp_dport, udp_sport, udp_dport]) as port from packets where ip_src is not null) where port is not null),
  tl as (select session_id, ip_src as ip, rtrim(dns_qname, '.') as qname from packets where ip_src is not null and length(dns_qname) > 3 and length(rtrim(dns_qname, '.')) > 3),
  dv as (select s.session_id, s.ip, coalesce(mac, '') as mac, coalesce(vendor, '') as vendor_oui, coalesce(substr(mac, 2, 1) in ('2', '3', '6', '7', 'a', 'b', 'e', 'f'), false) as rnd,
    (select bool_or(port in (22, 445)) from pp where pp.session_id = s.session_id and pp.ip = s.ip) as p1, (select bool_or(port in (9100, 443)) from pp where pp.session_id = s.session_id and pp.ip = s.ip) as p3,
    (select bool_or(regexp_matches(qname, '^device1[0-9]?[.]')) from tl where tl.session_id = s.session_id and tl.ip = s.ip and ends_with(qname, '.local')) as m2,
    (select bool_or(contains(qname, 'netflix')) from tl where tl.session_id = s.session_id and tl.ip = s.ip) as q3
    from (select distinct session_id, ip_src as ip from packets where ip_src is not null) s left join dom on dom.session_id = s.session_id and dom.ip = s.ip
    left join oui on substr(upper(replace(mac, ':', '')), 1, 6) = prefix6),
  rl as (select *, case when contains(lower(vendor_oui), 'apple') and p1 then 'r-apple-ssh' when m2 then 'r-dev1' when q3 and p3 then 'r-netflix' end as rule_id from dv),
  sg as (select distinct session_id, ip, fp, sig from tl, (values (0, 0, 'facebook'), (0, 1, 'youtube.com'), (0, 2, 'slack'), (1, 0, 'cdn.'), (1, 0, 'd111'), (1, 1, 'digicert'), (1, 2, 'bbc.co.uk'), (1, 3, 'facebook')) v(fp, sig, pat) where contains(lower(qname), pat)),
  fp as (select session_id, ip, fp, count(*) as n from sg group by session_id, ip, fp having count(*) >= 2 qualify row_number() over (partition by session_id, ip order by count(*) desc, fp) = 1) """


@C.add("j07_device_rule_match", _DEV + "select session_id, ip, rule_id, case rule_id when 'r-apple-ssh' then 'high' when 'r-dev1' then 'medium' when 'r-netflix' then 'low' end as confidence from rl")
def _(spark, d):
    p = packets(spark, d)
    src = p.where("ip_src is not null").select("session_id", F.col("ip_src").alias("ip")).distinct()
    dv = src.join(I.vendor_lookup(A.dominant_mac(p).select("session_id", "ip", "mac"), oui(spark)), ["session_id", "ip"], "left").fillna({"vendor_oui": ""})
    q = A.dns_timeline(p).select("session_id", "ip", "qname").distinct()
    return I.device_rule_match(dv, A.ip_ports(p), A.ip_mdns_names(p), q, RULES).select("session_id", "ip", "rule_id", "confidence")


@C.add("j08_dns_fingerprint_match", _DEV + """select session_id, ip, case fp when 0 then 'dns-fp:fp-social' else 'dns-fp:fp-cdn' end as rule_id, case fp when 0 then 'Phone' else 'PC' end || ' (DNS-matched, ' || n || ' signals)' as model,
  case fp when 0 then 'medium' else 'low' end as confidence from fp""")
def _(spark, d):
    q = A.dns_timeline(packets(spark, d)).select("session_id", "ip", "qname").distinct()
    return I.dns_fingerprint_match(q, PRINTS).select("session_id", "ip", "rule_id", "model", "confidence")


BEHAV_SQL = """bh as (select dv.session_id, dv.ip, case when bool_or(port = 554) then 'behav-rtsp' when bool_or(port in (9100, 631, 515)) then 'behav-printer' when bool_or(port in (5060, 5061, 2000)) then 'behav-voip'
  when bool_or(port in (8008, 8009, 8443)) and any_value(vendor_oui) like '%Google%' then 'behav-cast' when bool_or(port = 62078) then 'behav-iphone' when bool_or(port = 1900) then 'behav-ssdp' when bool_or(port in (1883, 8883)) then 'behav-mqtt'
  when bool_or(port in (80, 443, 8080, 8443)) and bool_and(port in (80, 443, 53, 5353, 67, 68, 123, 5060, 5061)) and (any_value(rnd) or any_value(vendor_oui) = '') then 'behav-web-mobile'
  when bool_or(port in (80, 443, 8080, 8443)) and bool_and(port in (80, 443, 53, 5353, 67, 68, 123, 5060, 5061)) then 'behav-web-computer' when any_value(vendor_oui) <> '' then 'behav-vendor-only' else 'behav-default' end as bid,
  any_value(vendor_oui) as vendor_oui from dv left join pp on pp.session_id = dv.session_id and pp.ip = dv.ip group by dv.session_id, dv.ip)"""


@C.add("d08_behavioural_class", _DEV + f", {BEHAV_SQL} select session_id, ip, bid as rule_id, case when bid in ('behav-iphone', 'behav-mqtt') then 'medium' when bid like 'behav-w%' or bid in ('behav-vendor-only', 'behav-default') then 'very-low' else 'low' end as confidence from bh")
def _(spark, d):
    p = packets(spark, d)
    dv = I.vendor_lookup(A.dominant_mac(p).select("session_id", "ip", "mac"), oui(spark))
    src = p.where("ip_src is not null").select("session_id", F.col("ip_src").alias("ip")).distinct()
    k = ["session_id", "ip"]
    dv = src.join(dv, k, "left").join(I.port_marks(A.ip_ports(p)), k, "left").fillna({"vendor_oui": ""})
    from packetloom.functions import is_random_mac
    return dv.withColumn("c", I.behavioural_class(F.col("vendor_oui"), is_random_mac(F.col("mac")))).select("session_id", "ip", "c.rule_id", "c.confidence")


_THREAT = (WF + """, npt as (select session_id, ip, count(*) as n_ports from (select distinct session_id, ip_src as ip, unnest([tcp_sport, tcp_dport, udp_sport, udp_dport]) as port from packets where ip_src is not null) where port is not null group by all),
  arpc as (select distinct session_id, arp_psrc as ip from packets where arp_psrc <> '0.0.0.0' and arp_hwsrc is not null group by session_id, arp_psrc having count(distinct arp_hwsrc) > 1),
  lng as (select session_id, ip_src as ip, count(distinct rtrim(dns_qname, '.')) as n_long from packets where ip_src is not null and length(rtrim(dns_qname, '.')) > 60 group by all),
  nxd as (select session_id, ip_dst as ip, count(*) as nx from packets where dns_rcode = '3' and dns_response = '1' and ip_dst is not null group by all),
  th0 as (select s.session_id, s.ip, coalesce(syn_count, 0) * 20 as syn, coalesce(unique_dsts, 0) * 4 as u, coalesce(rst_count, 0) * 20 as r, coalesce(n_ports, 0) as np, arpc.ip is not null as arp, coalesce(n_long, 0) as nl, coalesce(nx, 0) * 30 as nx
    from (select distinct session_id, ip_src as ip from packets where ip_src is not null) s left join features f on f.session_id = s.session_id and f.ip = s.ip left join npt on npt.session_id = s.session_id and npt.ip = s.ip
    left join arpc on arpc.session_id = s.session_id and arpc.ip = s.ip left join lng on lng.session_id = s.session_id and lng.ip = s.ip left join nxd on nxd.session_id = s.session_id and nxd.ip = s.ip),
  th1 as (select *, case when syn >= 1000 then 30 when syn >= 200 then 15 + least(15, (syn - 200) // 50) when syn >= 50 then least(10, syn // 20) else 0 end
    + case when u >= 200 then 20 when u >= 100 then 10 + (u - 100) // 20 when u >= 50 then 5 else 0 end + case when r >= 100 then least(10, r // 30) else 0 end + case when np >= 100 then 10 when np >= 30 then 5 else 0 end
    + case when arp then 25 else 0 end + least(15, nl * 3) + case when nx >= 50 then least(10, nx // 50) else 0 end as pts,
    (syn >= 50)::int + (u >= 50)::int + (r >= 100)::int + (np >= 30)::int + arp::int + (nl > 0)::int + (nx >= 50)::int as ns from th0),
  th as (select *, least(100, pts + case when ns >= 3 then 10 else 0 end) as score from th1) """)


@C.add("d06_threat_score", _THREAT + """select session_id, ip, cast(score as bigint) as threat_score, case when score >= 75 then 'CRITICAL' when score >= 50 then 'HIGH' when score >= 25 then 'MEDIUM' else 'LOW' end as threat_tier,
  case when ns = 0 then '-' else array_to_string(list_filter([case when syn >= 1000 then 'Severe SYN burst - ' || syn || ' packets' when syn >= 200 then 'TCP SYN burst - ' || syn || ' packets' when syn >= 50 then 'Elevated SYN count - ' || syn || ' packets' end,
  case when u >= 200 then u || ' unique destinations - heavy port scan' when u >= 100 then u || ' unique destinations - scan-like' when u >= 50 then u || ' unique destinations' end, case when r >= 100 then 'TCP RST flood - ' || r || ' packets' end,
  case when np >= 100 then np || ' distinct ports - likely port-scan footprint' when np >= 30 then np || ' distinct ports - broad port usage' end, case when arp then 'ARP IP↔MAC inconsistency - possible spoofing' end,
  case when nl > 0 then nl || ' long DNS queries from this IP (tunneling-like)' end, case when nx >= 50 then nx || ' NXDOMAIN responses to this IP' end, case when ns >= 3 then 'Compound risk - ' || ns || ' independent signals' end], lambda x: x is not null), '; ') end as threat_reasons from th""")
def _(spark, d):
    # Counts are scaled up so that every branch of the score is reached on the small tables.
    p = packets(spark, d)
    h = I.host_signals(p, A.ip_features(p)).withColumns({"syn_count": F.expr("syn_count * 20"), "rst_count": F.expr("rst_count * 20"),
                                                         "unique_dsts": F.expr("unique_dsts * 4"), "nxdomain": F.expr("nxdomain * 30")})
    return I.threat_score(h).select("session_id", "ip", "threat_score", "threat_tier", "threat_reasons")


@C.add("w08_rank_threats", _THREAT + """, ab as (select session_id, ip, cast(sum(len) as bigint) as bytes from (select session_id, ip_src as ip, len from packets union all select session_id, ip_dst, len from packets) where ip is not null group by all)
  select session_id, ip, cast(score as bigint) as threat_score, case when score >= 75 then 'CRITICAL' when score >= 50 then 'HIGH' when score >= 25 then 'MEDIUM' else 'LOW' end as threat_tier, bytes from th join ab using (session_id, ip)
  order by score >= 75 desc, score >= 50 desc, score >= 25 desc, score desc, bytes desc, ip""")
def _(spark, d):
    p = packets(spark, d)
    h = I.host_signals(p, A.ip_features(p)).withColumns({"syn_count": F.expr("syn_count * 20"), "rst_count": F.expr("rst_count * 20"),
                                                         "unique_dsts": F.expr("unique_dsts * 4"), "nxdomain": F.expr("nxdomain * 30")})
    scored = I.threat_score(h).join(I.address_bytes(p).select("session_id", "ip", "bytes"), ["session_id", "ip"])
    return I.rank_threats(scored).select("session_id", "ip", "threat_score", "threat_tier", "bytes")


def _inventory(spark, d):
    p = packets(spark, d)
    return I.local_inventory(p, A.ip_features(p), oui(spark), CONFIG)


_LOCAL = (_DEV + f""", {BEHAV_SQL}, ab as (select session_id, ip, cast(sum(len) as bigint) as bytes, count(*) filter (snt) as packets from (select session_id, ip_src as ip, len, true as snt from packets union all select session_id, ip_dst, len, false from packets) where ip is not null group by all),
  loc as (select rl.session_id, rl.ip, mac, rl.vendor_oui, ab.bytes, ab.packets, rnd as mac_privacy_random, coalesce(rule_id, case fp when 0 then 'dns-fp:fp-social' when 1 then 'dns-fp:fp-cdn' end, bid) as rule_id,
  coalesce(case rule_id when 'r-apple-ssh' then 'high' when 'r-dev1' then 'medium' when 'r-netflix' then 'low' end, case fp when 0 then 'medium' when 1 then 'low' end,
    case when bid in ('behav-iphone', 'behav-mqtt') then 'medium' when bid like 'behav-w%' or bid in ('behav-vendor-only', 'behav-default') then 'very-low' else 'low' end) as confidence
  from rl join ab using (session_id, ip) join bh on bh.session_id = rl.session_id and bh.ip = rl.ip left join fp on fp.session_id = rl.session_id and fp.ip = rl.ip where {private_sql('rl.ip')}) """)


@C.add("d07_local_inventory", _LOCAL + "select session_id, ip, mac, vendor_oui, bytes, packets, mac_privacy_random, rule_id, confidence, confidence in ('high', 'medium') as identified from loc")
def _(spark, d):
    return _inventory(spark, d).select("session_id", "ip", "mac", "vendor_oui", "bytes", "packets", "mac_privacy_random", "rule_id", "confidence", "identified")


_EXT = _BYTES + f""", ext as (select session_id, ip, bytes_in + bytes_out as bytes from io where not {private_sql('ip')}), {by_ip_sql('ext')},
  einv as (select session_id, ext.ip, bytes, coalesce(provider, 'Unknown') as provider, coalesce(service, '') as service, coalesce(type, 'Unclassified') as type, coalesce(rule_id, 'none') as rule_id,
    '' as rdns, provider is not null as identified from ext left join matches using (ip)) """


def _external(spark, d):
    return I.external_inventory(packets(spark, d), PROVIDERS)


@C.add("d09_external_inventory", _EXT + "select * from einv")
def _(spark, d):
    return _external(spark, d)


@C.add("a19_provider_rollup", _EXT + """, g as (select session_id, ip as provider, cast(sum(bytes) as bigint) as bytes, row_number() over (partition by session_id order by sum(bytes) desc, ip) as rank, count(*) over (partition by session_id) as n from einv group by session_id, ip)
  select session_id, provider, bytes, rank from g where rank <= 11 or n <= 12 union all select session_id, 'Other', cast(sum(bytes) as bigint), 12 from g where rank > 11 and n > 12 group by session_id""")
def _(spark, d):
    # Rolled up by address, which has more than twelve keys, so that the cut is exercised.
    g = I.provider_bytes(_external(spark, d).withColumn("provider", F.col("ip")))
    return K.top_n_plus_others(g, "provider", "bytes", n=11, label="Other", counted=None, only_above=12)


@C.add("a19_service_type_rollup", _EXT + "select session_id, type, cast(sum(bytes) as bigint) as bytes from einv group by all")
def _(spark, d):
    return I.provider_bytes(_external(spark, d), "type")


@C.add("a20_coverage", _LOCAL + f""", io as (select session_id, ip, cast(sum(len) as bigint) as bytes from (select session_id, ip_src as ip, len from packets union all select session_id, ip_dst, len from packets) where ip is not null group by all),
  ext as (select * from io where not {private_sql('ip')}), {by_ip_sql('ext')}, u as (select session_id, 'local' as side, bytes, confidence in ('high', 'medium') as identified from loc
  union all select session_id, 'external', bytes, provider is not null from ext left join matches using (ip))
  select session_id, side, count(*) as total_ips, count(*) filter (identified) as identified_ips, cast(sum(bytes) as bigint) as total_bytes, cast(coalesce(sum(bytes) filter (identified), 0) as bigint) as identified_bytes,
  {rd('100 * (count(*) filter (identified) / count(*))')} as pct_ips, {rd('coalesce(100 * (coalesce(sum(bytes) filter (identified), 0) / sum(bytes)), 0)')} as pct_bytes from u group by all""")
def _(spark, d):
    return I.coverage(_inventory(spark, d), _external(spark, d))


@C.add("d10_light_device_category", MACS_SQL + f""", {OUI_SQL}, qc as (select session_id, ip_src as ip, rtrim(dns_qname, '.') as q, count(*) as n, row_number() over (partition by session_id, ip_src order by count(*) desc, rtrim(dns_qname, '.')) as r
    from packets where dns_response <> '1' and ip_src is not null and rtrim(dns_qname, '.') <> '' group by session_id, ip_src, rtrim(dns_qname, '.')),
  hn as (select session_id, ip, arg_min(q, r) as hostname from qc where r <= 20 and ends_with(q, '.local') and not starts_with(q, '_') group by all),
  pc as (select session_id, ip, pt, row_number() over (partition by session_id, ip order by count(*) desc, pt) as r from (select session_id, ip_src as ip, tcp_dport || '/tcp' as pt from packets union all select session_id, ip_src, udp_dport || '/udp' from packets) where ip is not null and pt is not null group by session_id, ip, pt),
  pa as (select session_id, ip, list(cast(split_part(pt, '/', 1) as int)) as ports from pc where r <= 10 group by all),
  dv as (select s.session_id, s.ip, nullif(coalesce(vendor, ''), '') as oui_vendor, hostname, ports from (select distinct session_id, ip_src as ip from packets where ip_src is not null) s left join dom on dom.session_id = s.session_id and dom.ip = s.ip
    left join oui on substr(upper(replace(mac, ':', '')), 1, 6) = prefix6 left join hn on hn.session_id = s.session_id and hn.ip = s.ip left join pa on pa.session_id = s.session_id and pa.ip = s.ip)
  select session_id, ip, hostname, oui_vendor, case when list_has_any(ports, [62078, 5228]) then 'Mobile' when list_has_any(ports, [9100, 631, 515]) then 'Printer' when list_has_any(ports, [5060, 5061, 2000]) then 'VoIP Phone'
  when list_has_any(ports, [554]) then 'Camera' when oui_vendor like 'Apple%' then 'Desktop' when oui_vendor like 'Samsung%' then 'Consumer' else 'unknown' end as category from dv""")
def _(spark, d):
    return I.light_device_context(packets(spark, d), oui(spark))


# ---- browsing ---------------------------------------------------------------------------------

_CAT = """case when regexp_matches(lower(qname), 'netflix|youtube') then 'Streaming' when regexp_matches(lower(qname), 'slack') then 'Work/Enterprise' when regexp_matches(lower(qname), 'google') then 'Google/Cloud'
  when regexp_matches(lower(qname), 'cloudfront') then 'Cloud Infra' when regexp_matches(lower(qname), 'facebook') then 'Social' when regexp_matches(lower(qname), 'ocsp|digicert|crl|norton|okta') then 'Security/Update'
  when regexp_matches(lower(qname), 'bbc|n12') then 'News/Media' when regexp_matches(lower(qname), 'cdn|static|edge|cache|d[0-9a-z]+[.]net|2mdn') then 'CDN/Infra' else 'Other' end"""
_BR = _DN + """, nm as (select s.session_id, ip, max(qname) as name from sip s join dn on dn.session_id = s.session_id and contains(lower(ip), base) group by all),
  br as (select q.session_id, coalesce(name, ip_src) as device, qname, ts from q left join nm on nm.session_id = q.session_id and nm.ip = q.ip_src where ip_src is not null and not ends_with(qname, '.local') and not ends_with(qname, '.arpa')) """


def _named(spark, d):
    p = packets(spark, d)
    return p, I.name_devices(K.source_bytes(p), A.mdns_device_names(p))


@C.add("b01_w06_browsing_by_category", _BR + f""", g as (select session_id, device, {_CAT} as category, count(*) as "count" from br group by all), t as (select *, sum("count") over (partition by session_id, device) as t from g)
  select session_id, device, category, "count", {rd('"count" / t * 100')} as pct from t where t >= 5""")
def _(spark, d):
    return B.browsing_by_category(*_named(spark, d))


@C.add("b02_browsing_by_bins", _BR + """, b as (select session_id, device, cast(floor(ts / 21600) as bigint) * 21600 as bin_start, count(*) as n from br group by all), act as (select session_id, device from b group by all having sum(n) >= 5),
  sp as (select session_id, unnest(range(cast(floor(min(ts) / 21600) as bigint) * 21600, cast(floor(max(ts) / 21600) as bigint) * 21600 + 1, 21600)) as bin_start from packets group by session_id)
  select session_id, device, bin_start, coalesce(n, 0) as n from act join sp using (session_id) left join b using (session_id, device, bin_start)""")
def _(spark, d):
    return B.browsing_by_bins(*_named(spark, d), bin_s=21600)


@C.add("b03_p08_ip_domain_heatmap", _Q + """, sp as (select session_id, min(ts) as t0, max(ts) as t1 from packets group by all),
  r as (select q.session_id, array_to_string(string_split(qname, '.')[-2:], '.') as domain, greatest(0, least(29, cast(floor((ts - t0) / (greatest(1.0, t1 - t0) / 30)) as bigint))) as bin from q join sp using (session_id) where ip_src = '8.8.1.8' and not ends_with(qname, '.local') and not ends_with(qname, '.arpa')),
  tp as (select session_id, domain from r group by all qualify row_number() over (partition by session_id order by count(*) desc, domain) <= 25)
  select session_id, domain, bin, count(*) as n from r where (session_id, domain) in (select (session_id, domain) from tp) group by all""".replace("select session_id, domain from r group by all qualify", "select session_id, domain from r group by session_id, domain qualify"))
def _(spark, d):
    return B.ip_domain_heatmap(packets(spark, d), "8.8.1.8")


# Every minute of the sessions and every packet in it.
RATE_SQL = W + """, tl as (select session_id, ts, len from packets where ip_src is not null and ip_dst is not null), b0 as (select session_id, min(ts) as t0, max(ts) as t1 from tl group by all),
  gr as (select session_id, unnest(range(0, cast(floor((t1 - t0) / 60) as bigint) + 1)) as bin from b0), ps as (select session_id, cast(floor((ts - t0) / 60) as bigint) as bin, avg(len) as m from tl join b0 using (session_id) group by all),
  rate as (select session_id, bin, bin * 60 as second, coalesce(m, 0.0) as mean_size from gr left join ps using (session_id, bin)) """


@C.add("b05_w05_rate_series", RATE_SQL + f"select session_id, bin, second, {rd('mean_size')} as mean_size from rate")
def _(spark, d):
    return B.rate_series(packets(spark, d), bin_s=60)


@C.add("w03_lag_sequences", RATE_SQL + f", l as (select session_id, bin, second, mean_size, " + ", ".join(f"lag(mean_size, {i}) over (partition by session_id order by bin) as lag_{i}" for i in range(1, 11))
       + f" from rate) select session_id, bin, second, {rd('mean_size')} as target, " + ", ".join(f"{rd(f'lag_{i}')} as lag_{i}" for i in range(1, 11)) + " from l where lag_10 is not null")
def _(spark, d):
    return B.lag_sequences(B.rate_series(packets(spark, d), bin_s=60))


@C.add("w04_chronological_split", RATE_SQL + "select session_id, bin, row_number() over (partition by session_id order by bin) <= floor(count(*) over (partition by session_id) * 0.8) as is_train from rate")
def _(spark, d):
    return B.chronological_split(B.rate_series(packets(spark, d), bin_s=60)).select("session_id", "bin", "is_train")


# The same for every second; the results are summed by hour, as there are millions of seconds.
SECONDS_SQL = RATE_SQL.replace("/ 60)", "/ 1.0)").replace("bin * 60", "bin")


@C.add("b05_w05_rate_series_1s", SECONDS_SQL + f"select session_id, bin // 3600 as hour, count(*) as bins, max(bin) as last_bin, count(*) filter (mean_size > 0) as busy, {rd('sum(mean_size)', 3)} as size from rate group by all")
def _(spark, d):
    return _hours(B.rate_series(packets(spark, d)), F.count(F.lit(1)).alias("bins"), F.max("bin").alias("last_bin"), F.count_if(F.col("mean_size") > 0).alias("busy"), F.round(F.sum("mean_size"), 3).alias("size"))


@C.add("w03_lag_sequences_1s", SECONDS_SQL + ", l as (select session_id, bin, mean_size, " + ", ".join(f"lag(mean_size, {i}) over (partition by session_id order by bin) as lag_{i}" for i in range(1, 11))
       + ") select session_id, bin // 3600 as hour, count(*) as n, ".replace(") select", " from rate) select") + ", ".join(f"{rd(f'sum(mean_size * lag_{i}) / 1000', 3)} as p{i}" for i in range(1, 11)) + " from l where lag_10 is not null group by all")
def _(spark, d):
    rows = B.lag_sequences(B.rate_series(packets(spark, d)))
    return _hours(rows, F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col("target") * F.col(f"lag_{i}")) / 1000, 3).alias(f"p{i}") for i in range(1, 11)])


@C.add("w04_chronological_split_1s", SECONDS_SQL + ", s as (select session_id, bin, row_number() over (partition by session_id order by bin) <= floor(count(*) over (partition by session_id) * 0.8) as is_train from rate) select session_id, bin // 3600 as hour, count(*) filter (is_train) as train, count(*) as n from s group by all")
def _(spark, d):
    return _hours(B.chronological_split(B.rate_series(packets(spark, d))), F.count_if("is_train").alias("train"), F.count(F.lit(1)).alias("n"))


def _hours(series, *measures):
    return series.groupBy("session_id", F.floor(F.col("bin") / 3600).alias("hour")).agg(*measures)


@C.add("b07_view_health", FF + "select session_id, case when count(total_bytes) = 0 then 'empty' when count(*) >= 8 and min(total_bytes) = max(total_bytes) then 'uniform' else 'ok' end as health from flow_features group by all")
def _(spark, d):
    return K.view_health(A.ip_features(flows(spark, d)), "total_bytes", by=["session_id"])


_TAG = FEATURES_SQL + """, q95 as (select session_id, quantile_cont(burst_score, 0.95) as qb, quantile_cont(dominance, 0.95) as qd from features group by all)"""


@C.add("p23_m12_burst_outlier_tags", f"with {_TAG}" + """ select session_id, ip, coalesce(nullif(concat_ws(', ', case when syn_count > 1 then 'High SYN' end, case when rst_count > 1 then 'High RST' end, case when burst_score > qb then 'High Burst' end,
  case when dominance > qd then 'High Dominance' end, case when "count" = 2 then 'ML-flagged' end), ''), 'Within normal range') as tags from features join q95 using (session_id)""")
def _(spark, d):
    from packetloom.operators.scoring import burst_outlier_tags
    f = A.ip_features(packets(spark, d)).withColumn("anomaly", F.col("count") == 2)
    # Flag counts are scaled so that both limits are crossed on the small tables.
    f = f.withColumns({"syn_count": F.expr("case when syn_count > 1 then 101 else 0 end"), "rst_count": F.expr("case when rst_count > 1 then 51 else 0 end")})
    return burst_outlier_tags(f).select("session_id", "ip", "tags")
