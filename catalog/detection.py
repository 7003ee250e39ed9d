"""Rules, behavioural engines, fusion, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import common, engines as E, features as A, rules as D
from packetloom.operators.providers import Providers

from .base import FLOWS_SQL, Catalog, flows, local_scope_sql, ipnum_sql, packets, rd, rdd, stored
from .features import ARP_SQL, W, WF, reg_sql

C = Catalog()

PROVIDERS = Providers(
    static=(("142.250.1.5", "StaticCo", "Pinned host", "Fixed"),),
    cidrs=(("52.0.0.0/8", "Amazon", "AWS", "Cloud"), ("52.10.0.0/16", "Shadowed", "never", "Cloud"),
           ("142.250.0.0/15", "Google", "Search", "Web"), ("157.240.0.0/17", "Meta", "Social", "Social"),
           ("8.8.0.0/16", "Google", "DNS", "Resolver"), ("2600:9000::/28", "Amazon", "CloudFront", "CDN")),
    patterns=(("google|youtube", "Google", "Search", "Web"), ("netflix", "Netflix", "Video", "Streaming"),
              (r"facebook\.com$", "Meta", "Social", "Social"), ("cloudfront|youtube", "Amazon", "CloudFront", "CDN")),
)
# v4 and v6 lookups of the same tables, stated as ranges.
PROV_SQL = """prov(lo, hi, ord, provider, service, type) as (values (872415232, 889192447, 0, 'Amazon', 'AWS', 'Cloud'),
  (873070592, 873136127, 1, 'Shadowed', 'never', 'Cloud'), (2398748672, 2398879743, 2, 'Google', 'Search', 'Web'),
  (2649751552, 2649784319, 3, 'Meta', 'Social', 'Social'), (134742016, 134807551, 4, 'Google', 'DNS', 'Resolver'))"""


def by_ip_sql(src: str) -> str:
    """CTE text: matches(ip, provider, service, type, rule_id) for the addresses of ``src``."""
    return (f"""{PROV_SQL}, nums as (select distinct ip, {ipnum_sql('ip')} as num from {src}),
  matches as (select ip, provider, service, type, case when ord = -1 then 'static' else 'cidr' end as rule_id from (
    select ip, ord, provider, service, type from nums join prov on num between lo and hi
    union all select ip, 5, 'Amazon', 'CloudFront', 'CDN' from nums where starts_with(ip, '2600:9000:')
    union all select ip, -1, 'StaticCo', 'Pinned host', 'Fixed' from nums where ip = '142.250.1.5')
    qualify row_number() over (partition by ip order by ord) = 1)""")


HOST_SQL = ("case when regexp_matches({0}, 'google|youtube') then 'Google' when contains({0}, 'netflix') then 'Netflix' "
            "when ends_with({0}, 'facebook.com') then 'Meta' when contains({0}, 'cloudfront') then 'Amazon' end")

# ---- rules ------------------------------------------------------------------------------------

_SCAN = ("scan as (select session_id, ip as src, type, n as \"count\", unique_dsts, {r} as ratio from (select session_id, ip, \"count\" as pk, unique_dsts, "
         "unnest(['SYN', 'FIN', 'NULL', 'XMAS']) as type, unnest([syn_count, fin_count, null_count, xmas_count]) as n from {f}) "
         "where n > {floor} and ((unique_dsts > {d} and n / greatest(pk, 1) > {s}) or n / greatest(pk, 1) > {l}))")


def scan_sql(f="features", floor=3, d=4, s=0.1, l=0.4):
    return _SCAN.format(r=rdd("n / greatest(pk, 1)", 2), f=f, floor=floor, d=d, s=s, l=l)


LOW_SCAN = dict(floor=3, min_dsts=4, spread_ratio=0.1, lone_ratio=0.4)


@C.add("d01_scan_alerts", WF + f", {scan_sql()} select * from scan")
def _(spark, d):
    return D.scan_alerts(A.ip_features(packets(spark, d)), **LOW_SCAN)


@C.add("d01_scan_alerts_volume", f"with {FLOWS_SQL}, {scan_sql('flow_features', 50, 20, 0.25, 0.7)} select * from scan")
def _(spark, d):
    return D.scan_alerts(A.ip_features(flows(spark, d)))


_FLOOD = f""", span as (select session_id, greatest(max(ts) - min(ts), 1.0) as span from packets group by all),
  syn as (select session_id, cast(sum(syn_count) as bigint) as total_syn, count(*) as syn_sources from flagcnt where syn_count > 0 group by all),
  flood as (select session_id, 'SYN_FLOOD' as type, total_syn, syn_sources, {rdd('total_syn / span', 1)} as syn_per_sec, {rdd('total_syn / syn_sources', 2)} as syn_per_source,
  total_syn / syn_sources <= 3 as spoofed_source_pattern from syn join span using (session_id) where total_syn >= 10 and syn_sources >= 5 and total_syn / span >= 0.0001)"""
LOW_FLOOD = dict(min_syn=10, min_sources=5, min_rate=0.0001)


@C.add("d02_syn_flood", WF + _FLOOD + " select * from flood")
def _(spark, d):
    return D.syn_flood(packets(spark, d), **LOW_FLOOD)


_AMP = f""", amp as (select session_id, ip_src as src, count(*) as responses, {rdd('avg(len)', 1)} as mean_size from packets where dns_response = '1' and udp_sport = 53
  and ip_src is not null group by all having count(*) >= 20 and avg(len) >= 200)"""
LOW_AMP = dict(min_responses=20, min_mean=200.0)


@C.add("d03_dns_amplification", W + _AMP + " select * from amp")
def _(spark, d):
    return D.dns_amplification(packets(spark, d), **LOW_AMP)


@C.add("d04_arp_spoofing", ARP_SQL + "select * from (select session_id, ip, mac, count(*) over (partition by session_id, ip) as n_macs from claims) where n_macs > 1")
def _(spark, d):
    return D.arp_spoofing(packets(spark, d))


@C.add("d05_cleartext_credentials", W + f""", t as (select *, trim(payload) as line from packets where payload is not null),
  h as (select *, unnest([case when 21 in (tcp_dport, tcp_sport) and starts_with(line, 'USER') then 'USER' end, case when 21 in (tcp_dport, tcp_sport) and starts_with(line, 'PASS') then 'PASS' end,
  case when 21 in (tcp_dport, tcp_sport) and starts_with(line, 'RETR') then 'RETR' end, case when 21 in (tcp_dport, tcp_sport) and starts_with(line, 'STOR') then 'STOR' end,
  case when (tcp_dport in (25, 587) or tcp_sport in (25, 587)) and contains(payload, 'MAIL FROM') then 'MAIL FROM' end,
  case when (tcp_dport in (25, 587) or tcp_sport in (25, 587)) and contains(payload, 'RCPT TO') then 'RCPT TO' end,
  case when (tcp_dport in (25, 587) or tcp_sport in (25, 587)) and contains(payload, 'DATA') then 'DATA' end]) as word from t)
  select session_id, {rd('ts')} as ts, ip_src as src, ip_dst as dst, substr(line, 1, 80) as line, case when word in ('USER', 'PASS', 'RETR', 'STOR') then 'ftp' else 'smtp' end as protocol, word from h where word is not null""")
def _(spark, d):
    return D.cleartext_credentials(packets(spark, d))


@C.add("k05_top_flag_sources", WF + """, l as (select session_id, ip, unnest(['SYN', 'RST', 'FIN', 'NULL', 'XMAS']) as type, unnest([syn_count, rst_count, fin_count, null_count, xmas_count]) as n from flagcnt)
  select session_id, ip, type, n, row_number() over (partition by session_id, type order by n desc, ip) as rank from l where n > 0 qualify rank <= 10""")
def _(spark, d):
    return D.top_flag_sources(A.flag_counters(packets(spark, d)))


@C.add("u04_rule_detected_ips", WF + f", {scan_sql()} {_AMP}, " + ARP_SQL.split(", claims", 1)[1].join([" claims", ""]).rstrip()
       + """ select distinct session_id, ip from (select session_id, src as ip from scan union all select session_id, src from amp
  union all select session_id, ip from claims group by session_id, ip having count(*) > 1)""")
def _(spark, d):
    p = packets(spark, d)
    return D.rule_detected_ips(D.scan_alerts(A.ip_features(p), **LOW_SCAN), D.dns_amplification(p, **LOW_AMP), D.arp_spoofing(p))


@C.add("s08_flatten_findings", WF + f", {scan_sql()} {_FLOOD} {_AMP}, " + ARP_SQL.split(", claims", 1)[1].join([" claims", ""]).rstrip() + """,
  fnd as (select session_id, 'scan_alerts' as rule, src as ip from scan union all select session_id, 'flood_alerts', null from flood union all select session_id, 'amp_alerts', src from amp
  union all (select session_id, 'arp_spoofing_ips', ip from claims qualify count(*) over (partition by session_id, ip) > 1)
  union all select distinct session_id, 'dns_long_queries' || coalesce(null, ''), null from (select distinct session_id, rtrim(dns_qname, '.') as q from packets where length(rtrim(dns_qname, '.')) > 60) where false
  union all select session_id, 'dns_long_queries', null from (select distinct session_id, rtrim(dns_qname, '.') as q from packets where length(rtrim(dns_qname, '.')) > 60)
  union all select distinct session_id, 'dns_nxdomain', ip_dst from packets where dns_rcode = '3' and dns_response = '1')
  select session_id, 'rules' as layer, rule, ip, 'high' as severity, count(*) as n from fnd group by all""")
def _(spark, d):
    p = packets(spark, d)
    f = D.findings(p, A.ip_features(p), scan=LOW_SCAN, flood=LOW_FLOOD, amp=LOW_AMP)
    return f.where("detail_json is not null").groupBy("session_id", "layer", "rule", "ip", "severity").agg(F.count("*").alias("n"))


@C.add("s08_finding_bodies", W + """, nx as (select session_id, ip_dst as ip, count(*) as n from packets where dns_rcode = '3' and dns_response = '1' group by all)
  select session_id, 'dns_nxdomain' as rule, ip, '{' || coalesce('"ip":"' || ip || '",', '') || '"nxdomain":' || n || '}' as detail_json from nx
  union all select distinct session_id, 'dns_long_queries', null, '{"qname":"' || rtrim(dns_qname, '.') || '"}' from packets where length(rtrim(dns_qname, '.')) > 60""")
def _(spark, d):
    p = packets(spark, d)
    return D.findings(p, A.ip_features(p)).where("rule in ('dns_nxdomain', 'dns_long_queries')").select("session_id", "rule", "ip", "detail_json")


# ---- engines ----------------------------------------------------------------------------------

_OUT = ("select session_id, device, peer, signal, tactic, technique, " + rd("score") + " as score, severity, \"count\", "
        + rd("first_ts") + " as first_ts, " + rd("last_ts") + " as last_ts, detail from sig")
MITM = "'Collection / MITM' as tactic, 'T1557.002' as technique"
BADMAC = "('00:00:00:00:00:00', 'ff:ff:ff:ff:ff:ff')"

E01 = f""", arp as (select session_id, arp_psrc as ip, arp_hwsrc as mac, arp_opcode as op, ts from packets where arp_hwsrc is not null),
  grat as (select session_id, mac from arp where mac not in {BADMAC} group by all having count(*) filter (op = '2') > 0 and count(*) filter (op = '2') > count(*) filter (op = '1')),
  sig as (select session_id, ip as device, string_agg(distinct mac, ';' order by mac) filter (mac not in {BADMAC}) as peer, 'arp_ip_multi_mac' as signal, {MITM},
  case when bool_or((session_id, mac) in (select (session_id, mac) from grat)) then least(1.0, 0.6 + 0.15 * count(distinct mac) filter (mac not in {BADMAC})) else 0.5 end as score,
  case when bool_or((session_id, mac) in (select (session_id, mac) from grat)) then 'high' else 'low' end as severity, count(*) as "count", min(ts) as first_ts, max(ts) as last_ts,
  'IP ' || ip || ' claimed by ' || count(distinct mac) filter (mac not in {BADMAC}) || ' MACs' || case when bool_or((session_id, mac) in (select (session_id, mac) from grat)) then ' + gratuitous reply signature' else ' (no gratuitous reply)' end as detail
  from arp where ip is not null and ip <> '0.0.0.0' group by session_id, ip having count(distinct mac) filter (mac not in {BADMAC}) > 1) """


@C.add("e01_arp_ip_multi_mac", W + E01 + _OUT)
def _(spark, d):
    return E.arp_ip_multi_mac(packets(spark, d))


E02 = f""", sig as (select session_id, mac as device, (select string_agg(i, ';' order by i) from unnest(list_sort(list(distinct ip) filter (ip <> '0.0.0.0'))[1:8]) t(i)) as peer, 'arp_mac_many_ips' as signal, {MITM},
  least(1.0, 0.5 + 0.08 * count(distinct ip) filter (ip <> '0.0.0.0')) as score, 'high' as severity, count(*) as "count", min(ts) as first_ts, max(ts) as last_ts,
  'MAC ' || mac || ' announced ' || count(distinct ip) filter (ip <> '0.0.0.0') || ' distinct IPs' as detail
  from (select session_id, arp_psrc as ip, arp_hwsrc as mac, ts from packets where arp_hwsrc is not null and arp_psrc is not null) where mac not in {BADMAC}
  group by session_id, mac having count(distinct ip) filter (ip <> '0.0.0.0') >= 2) """
E02 = E02.replace("(select string_agg(i, ';' order by i) from unnest(list_sort(list(distinct ip) filter (ip <> '0.0.0.0'))[1:8]) t(i))",
                  "array_to_string(list_sort(list(distinct ip) filter (ip <> '0.0.0.0'))[1:8], ';')")


@C.add("e02_arp_mac_many_ips", W + E02 + _OUT)
def _(spark, d):
    return E.arp_mac_many_ips(packets(spark, d), min_ips=2)


E03 = f""", sig as (select session_id, arp_hwsrc as device, '' as peer, 'arp_gratuitous_flood' as signal, {MITM}, least(1.0, 0.4 + count(*) filter (arp_opcode = '2') / 120.0) as score,
  'medium' as severity, count(*) filter (arp_opcode = '2') as "count", min(ts) filter (arp_opcode = '2') as first_ts, max(ts) filter (arp_opcode = '2') as last_ts,
  count(*) filter (arp_opcode = '2') || ' ARP replies vs ' || count(*) filter (arp_opcode = '1') || ' requests (unsolicited)' as detail
  from packets where arp_hwsrc is not null and arp_hwsrc not in {BADMAC} group by session_id, arp_hwsrc
  having count(*) filter (arp_opcode = '2') >= 4 and count(*) filter (arp_opcode = '2') > 3 * greatest(count(*) filter (arp_opcode = '1'), 1)) """


@C.add("e03_arp_gratuitous_flood", W + E03 + _OUT)
def _(spark, d):
    return E.arp_gratuitous_flood(packets(spark, d), min_replies=4)


E04 = """, srv as (select session_id, dhcp_sid as s, count(*) as n, min(ts) as f, max(ts) as l from packets where dhcp_sid is not null group by all),
  sig as (select session_id, s as device, string_agg(s, ';') over (partition by session_id order by s rows between unbounded preceding and unbounded following) as peer, 'rogue_dhcp' as signal,
  'Collection / MITM' as tactic, 'T1557' as technique, 0.7 as score, 'high' as severity, n as "count", f as first_ts, l as last_ts,
  count(*) over (partition by session_id) || ' DHCP servers offering leases' as detail from srv qualify count(*) over (partition by session_id) > 1) """


@C.add("e04_rogue_dhcp", W + E04 + _OUT)
def _(spark, d):
    return E.rogue_dhcp(packets(spark, d))


@C.add("e04_dhcp_servers", W + f"select session_id, dhcp_sid as server, count(*) as n, {rd('min(ts)')} as first_ts, {rd('max(ts)')} as last_ts from packets where dhcp_sid is not null group by all")
def _(spark, d):
    return E.dhcp_servers(packets(spark, d))


@C.add("e01_claimed_macs", W + f"""select session_id, arp_psrc as ip, arp_hwsrc as mac, count(*) as n, count(*) over (partition by session_id, arp_psrc) as n_macs, {rd('min(ts)')} as first_ts, {rd('max(ts)')} as last_ts
  from packets where arp_psrc is not null and arp_hwsrc is not null and arp_psrc <> '0.0.0.0' and arp_hwsrc not in {BADMAC} group by session_id, arp_psrc, arp_hwsrc qualify count(*) over (partition by session_id, arp_psrc) > 1""")
def _(spark, d):
    return E.claimed_macs(packets(spark, d))


_ENT = "(select -sum(n / t * log2(n / t)) from (select c, count(*) as n, sum(count(*)) over () as t from unnest(string_split({0}, '')) u(c) where c <> '' group by c))"
E05 = f""", nm as (select distinct dns_qname as name from packets where dns_qname is not null),
  chr as (select name, unnest(string_split(split_part(trim(name, '.'), '.', 1), '')) as c from nm),
  ent as (select name, -sum(n / t * log2(n / t)) as ent from (select name, c, count(*) as n, sum(count(*)) over (partition by name) as t from chr where c <> '' group by name, c) group by name),
  q as (select session_id, ip_src, dns_qname, ts, {reg_sql('dns_qname')} as reg, ent from packets left join ent on dns_qname = name where dns_qname is not null and dns_response <> '1'),
  ask as (select session_id, reg, ip_src, row_number() over (partition by session_id, reg order by count(*) desc, ip_src) as r from q where ip_src is not null group by session_id, reg, ip_src),
  g as (select session_id, reg, count(distinct dns_qname) as uniq, count(*) as total, max(coalesce(ent, 0)) as me, avg(length(dns_qname)) as ml, min(ts) as f, max(ts) as l from q where reg <> '' group by all),
  sig as (select g.session_id, coalesce(ip_src, '') as device, g.reg as peer, 'dns_tunneling' as signal, 'Exfiltration / C2' as tactic, 'T1071.004' as technique,
  least(1.0, 0.4 + 0.3 * (me / 4.5) + 0.3 * least(uniq / 200.0, 1)) as score, 'high' as severity, uniq as "count", f as first_ts, l as last_ts,
  uniq || ' unique subdomains under ' || g.reg || format(' (uniq_ratio={{:.2f}}, max_entropy={{:.2f}}, mean_len={{:.0f}})', uniq / total, me, ml) as detail
  from g left join (select * from ask where r = 1) a on a.session_id = g.session_id and a.reg = g.reg where uniq >= 10 and uniq / total >= 0.9 and (me >= 3.0 or ml >= 40)) """


@C.add("e05_dns_tunneling", W + E05 + _OUT)
def _(spark, d):
    return E.dns_tunneling(packets(spark, d), min_unique=10, min_entropy=3.0)


E06 = """, sig as (select session_id, ip_dst as device, '' as peer, 'nxdomain_storm' as signal, 'Command and Control' as tactic, 'T1568.002' as technique, least(1.0, 0.3 + count(*) / 300.0) as score,
  'medium' as severity, count(*) as "count", min(ts) as first_ts, max(ts) as last_ts, count(*) || ' NXDOMAIN responses (failed lookups - DGA/tunnel symptom)' as detail
  from packets where dns_qname is not null and dns_response = '1' and dns_rcode = '3' and ip_dst is not null group by session_id, ip_dst having count(*) >= 2) """


@C.add("e06_nxdomain_storm", W + E06 + _OUT)
def _(spark, d):
    return E.nxdomain_storm(packets(spark, d), min_failed=2)


_BRANDS = "['" + "','".join(E.COMMON_LABELS) + "']"
MODEL_SQL = f""", resolved as (select session_id, split_part({reg_sql('dns_qname')}, '.', 1) as label from (select distinct session_id, dns_qname from packets where dns_response = '1' and dns_rcode = '0' and dns_qname is not null)),
  base as (select * from resolved where length(label) >= 3),
  train as (select session_id, label from base union all select session_id, unnest({_BRANDS}) from (select distinct session_id from packets p where dns_response <> '1' and dns_qname is not null
    and (select count(distinct label) from base b where b.session_id = p.session_id) < {{min_base}})),
  tb as (select session_id, substr('^' || lower(label) || '$', i, 2) as pair from train, lateral (select unnest(range(1, length(label) + 2)) as i)),
  mc as (select session_id, pair, count(*) as c from tb group by all),
  mr as (select session_id, substr(pair, 1, 1) as a, sum(c) as rt from mc group by all),
  asked as (select session_id, ip_src, dns_qname, ts, split_part({reg_sql('dns_qname')}, '.', 1) as label from packets where dns_qname is not null and dns_response <> '1'),
  lab as (select distinct session_id, label from asked where length(label) >= 7),
  toscore as (select * from lab union select session_id, unnest({_BRANDS}) from (select distinct session_id from lab)),
  sb as (select session_id, label, substr('^' || lower(label) || '$', i, 2) as pair from toscore, lateral (select unnest(range(1, length(label) + 2)) as i)),
  scored as (select sb.session_id, label, avg(ln((coalesce(c, 0) + 1) / (coalesce(rt, 0) + 41))) as lp from sb left join mc on mc.session_id = sb.session_id and mc.pair = sb.pair
    left join mr on mr.session_id = sb.session_id and mr.a = substr(sb.pair, 1, 1) group by sb.session_id, label),
  thr as (select session_id, least((select avg(lp) - stddev_pop(lp) from scored s join lab using (session_id, label) where s.session_id = x.session_id),
    (select quantile_cont(lp, 0.05) from scored s where s.session_id = x.session_id and list_contains({_BRANDS}, label))) as thr from (select distinct session_id from lab) x),
  lch as (select label, unnest(string_split(label, '')) as c from (select distinct label from lab)),
  lent as (select label, -sum(n / t * log2(n / t)) as ent from (select label, c, count(*) as n, sum(count(*)) over (partition by label) as t from lch where c <> '' group by label, c) group by label)"""
V = "length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(label)"


@C.add("p12_char_bigram_model", W + MODEL_SQL.format(min_base=30) + f" select s.session_id, label, {rd('lp')} as logprob, {rd('thr')} as threshold from scored s join lab using (session_id, label) join thr using (session_id)")
def _(spark, d):
    return E.dga_labels(packets(spark, d)).select("session_id", "label", "logprob", "threshold")


E07 = MODEL_SQL.format(min_base=500) + f""", fl as (select session_id, label, lp, thr, ent, {V} as vw from scored join lab using (session_id, label) join thr using (session_id) join lent using (label)
    where lp < thr and ent >= 2.5 and {V} < 0.25),
  ask7 as (select session_id, label, ip_src, row_number() over (partition by session_id, label order by count(*) desc, ip_src) as r from asked where ip_src is not null group by session_id, label, ip_src),
  sig as (select fl.session_id, coalesce(k.ip_src, '') as device, fl.label as peer, 'dga_domain' as signal, 'Command and Control' as tactic, 'T1568.002' as technique,
  least(1.0, 0.4 + least(thr - lp, 3.0) / 6.0 + 0.2) as score, 'medium' as severity, n as "count", f as first_ts, l as last_ts,
  'label ''' || fl.label || format(''' entropy={{:.2f}}, vowel_ratio={{:.2f}}', ent, vw) as detail from fl
  join (select session_id, label, count(distinct dns_qname) as n, min(ts) as f, max(ts) as l from asked group by all) s using (session_id, label)
  left join (select * from ask7 where r = 1) k on k.session_id = fl.session_id and k.label = fl.label) """.replace("{{", "{").replace("}}", "}")


@C.add("e07_dga_domains", W + E07 + _OUT)
def _(spark, d):
    return E.dga_domains(packets(spark, d), min_entropy=2.5, min_base=500)


BEACON_SQL = """, st as (select session_id, ip_src, ip_dst, ts, len, tcp_dport, udp_dport from packets where ip_src is not null and ip_dst is not null
    and ((proto = 'TCP' and tcp_flags in ('0x02', '0x0002', '0x00000002', '2')) or proto = 'UDP')),
  df as (select *, ts - lag(ts) over (partition by session_id, ip_src, ip_dst order by ts) as gap from st),
  qs as (select session_id, ip_src, ip_dst, count(*) as n, min(ts) as f, max(ts) as l, quantile_cont(gap, 0.25) as q1, quantile_cont(gap, 0.5) as q2, quantile_cont(gap, 0.75) as q3,
    quantile_cont(cast(len as double), 0.5) as sm, count(*) filter (tcp_dport = 123 or udp_dport = 123) as ntp from df group by all having count(*) >= 3),
  md as (select d.session_id, d.ip_src, d.ip_dst, quantile_cont(abs(gap - q2), 0.5) as mad, quantile_cont(abs(len - sm), 0.5) as smad from df d join qs using (session_id, ip_src, ip_dst) group by all),
  bs as (select *, case when q3 - q1 = 0 then 1.0 else greatest(0.0, 1 - abs((q3 + q1 - 2 * q2) / (q3 - q1))) end as skew,
    case when q2 = 0 then 1.0 else greatest(0.0, 1 - least(mad / q2, 1.0)) end as disp, case when sm = 0 then 1.0 else greatest(0.0, 1 - least(smad / sm, 1.0)) end as size
    from qs join md using (session_id, ip_src, ip_dst))"""


@C.add("e08_beacon_scores", W + BEACON_SQL + f""" select session_id, ip_src, ip_dst, n, {rd('f')} as first_ts, {rd('l')} as last_ts, {rd('q2')} as median_interval, {rd('skew')} as skew, {rd('disp')} as disp,
  {rd('size')} as size, {rd('(skew + disp + size) / 3')} as score from bs""")
def _(spark, d):
    p = packets(spark, d).where("ip_src is not null and ip_dst is not null and ((proto = 'TCP' and tcp_flags in ('0x02', '0x0002', '0x00000002', '2')) or proto = 'UDP')")
    return E.beacon_scores(p.select("session_id", "ip_src", "ip_dst", "ts", "len"), ["session_id", "ip_src", "ip_dst"])


E09 = BEACON_SQL + f""", sig as (select session_id, ip_src as device, ip_dst as peer, 'beaconing' as signal, 'Command and Control' as tactic, 'T1071' as technique, (skew + disp + size) / 3 as score,
  case when (skew + disp + size) / 3 >= 0.9 then 'high' else 'medium' end as severity, n as "count", f as first_ts, l as last_ts,
  format('{{}} conns, median interval {{:.1f}}s', n, q2) as detail from bs where n >= 4 and ntp = 0 and {local_scope_sql('ip_src')} and not {local_scope_sql('ip_dst')} and q2 >= 1 and (skew + disp + size) / 3 >= 0.5) """


@C.add("e09_beaconing", W + E09 + _OUT)
def _(spark, d):
    return E.beaconing(packets(spark, d), min_events=4, min_score=0.5)


E10A = f""", sig as (select session_id, ip_src as device, substr(tls_ja3, 1, 16) as peer, 'rare_ja3' as signal, 'Command and Control' as tactic, 'T1071.001' as technique, 0.5 as score, 'low' as severity, 1::bigint as "count",
  ts as first_ts, ts as last_ts, 'JA3 ' || tls_ja3 || ' seen once on ' || ip_src || ' to external ' || ip_dst || ' (new/unusual client)' as detail
  from (select *, count(*) over (partition by session_id, tls_ja3) as n from packets where tls_ja3 is not null) where n = 1 and ip_src is not null and ip_dst is not null and not {local_scope_sql('ip_dst')}) """


@C.add("e10_rare_ja3", W + E10A + _OUT)
def _(spark, d):
    return E.rare_ja3(packets(spark, d))


E10B = f""", sig as (select session_id, ip_src as device, array_to_string(list_sort(list(distinct ip_dst))[1:5], ';') as peer, 'tls_no_sni_external' as signal, 'Command and Control' as tactic, 'T1071.001' as technique,
  0.45 as score, 'low' as severity, count(*) as "count", min(ts) as first_ts, max(ts) as last_ts, count(*) || ' TLS handshakes to external IPs without SNI' as detail
  from packets where tls_ja3 is not null and tls_sni is null and ip_dst is not null and ip_src is not null and not {local_scope_sql('ip_dst')} group by session_id, ip_src) """


@C.add("e10_tls_no_sni_external", W + E10B + _OUT)
def _(spark, d):
    return E.tls_no_sni_external(packets(spark, d))


_TRIO = f""", trio as (select session_id, ip_src, ip_dst, tls_sni, min(ts) as ts from packets where tls_sni is not null and ip_dst is not null and not {local_scope_sql('ip_dst')} group by all),
  dips as (select distinct ip_dst as ip from trio), {by_ip_sql('dips')}"""
E10C = _TRIO + f""", sig as (select session_id, ip_src as device, tls_sni as peer, 'sni_ip_mismatch' as signal, 'Command and Control' as tactic, 'T1090' as technique, 0.6 as score, 'medium' as severity, 1::bigint as "count",
  ts as first_ts, ts as last_ts, 'SNI ' || tls_sni || ' -> ' || np || ', but dst ' || ip_dst || ' -> ' || provider || ' (possible domain fronting)' as detail
  from (select trio.*, {HOST_SQL.format('tls_sni')} as np, m.provider from trio join matches m on m.ip = trio.ip_dst) where np <> provider) """


@C.add("e10_j06_sni_ip_mismatch", W + E10C + _OUT)
def _(spark, d):
    return E.sni_ip_mismatch(packets(spark, d), PROVIDERS)


# ---- union, fusion ----------------------------------------------------------------------------

LIMITS = {"arp_mac_many_ips": dict(min_ips=2), "arp_gratuitous_flood": dict(min_replies=4), "dns_tunneling": dict(min_unique=10, min_entropy=3.0),
          "nxdomain_storm": dict(min_failed=2), "dga_domains": dict(min_entropy=2.5, min_base=500),
          "beaconing": dict(min_events=4, min_score=0.5)}


def _renamed(text: str, i: int) -> str:
    """Give the signal CTE of one engine its own name, so that all can stand in one statement."""
    return text.replace("sig as (", f"sig{i} as (")


_PARTS = [E01, E02, E03, E04, E05, E06, E07, BEACON_SQL + E09[len(BEACON_SQL):], E10A, E10B, E10C]
SIGNALS_SQL = (W + "".join(_renamed(t, i) for i, t in enumerate(_PARTS)) + ", sig as ("
               + " union all ".join(f"select session_id, device, peer, signal, tactic, technique, cast(score as double) as score, severity, \"count\", first_ts, last_ts, detail from sig{i}" for i in range(len(_PARTS))) + ") ")


def signals(spark, d):
    """The signal table as it is kept per session: written once, read by fusion and the reports."""
    return stored(spark, d, "adv_signals", lambda: E.all_signals(packets(spark, d), PROVIDERS, limits=LIMITS, stage_each=True))


@C.add("u01_all_signals", SIGNALS_SQL + _OUT)
def _(spark, d):
    return signals(spark, d)


RISK_SQL = f""", ev as (select distinct session_id, device, first_ts, technique from sig), near as (select a.session_id, a.device, a.first_ts, count(distinct b.technique) as k from ev a join ev b on a.session_id = b.session_id and a.device = b.device
    and b.first_ts between a.first_ts - 900000 and a.first_ts group by all), best as (select session_id, device, max(k) as best from near group by all),
  sf as (select session_id, device, signal, min(first_ts) as t, row_number() over (partition by session_id, device order by min(first_ts), signal) as r from sig group by session_id, device, signal),
  nm2 as (select session_id, device, string_agg(signal, '; ' order by r) as detail from sf where r <= 6 group by all),
  risk as (select session_id, device, count(*) as signals, count(distinct signal) as signal_types, max(score) as base, 1 + 0.5 * greatest(any_value(best) - 1, 0) as boost,
    string_agg(distinct technique, ';' order by technique) as techniques, any_value(nm2.detail) as detail, min(first_ts) as window_start from sig join best using (session_id, device) join nm2 using (session_id, device) group by all) """


def _fused(spark, d):
    return E.kill_chain_fusion(signals(spark, d), window_s=900_000)


_RISK_OUT = f"""select session_id, device, signals, signal_types, {rdd('base', 3)} as max_score, {rdd('boost', 2)} as kill_chain_boost, {rdd('least(1.0, base * boost)', 3)} as risk, techniques, detail, {rd('window_start')} as window_start from risk"""
SIGNALS_SQL_R = SIGNALS_SQL.replace("ev as (select *, cast(regexp", "evt as (select *, cast(regexp").replace(" from ev)", " from evt)")


@C.add("e11_kill_chain_fusion", SIGNALS_SQL_R + RISK_SQL + _RISK_OUT)
def _(spark, d):
    return _fused(spark, d)


@C.add("k08_top_devices_by_risk", f"select * from ({SIGNALS_SQL_R + RISK_SQL + _RISK_OUT}) order by risk desc, device, session_id limit 20")
def _(spark, d):
    return E.top_devices_by_risk(_fused(spark, d))


@C.add("e12_advanced_signals_by_ip", SIGNALS_SQL_R + RISK_SQL + f""", w as (select session_id, device, signal, case when signal = 'beaconing' then 'b' when signal in ('dns_tunneling', 'nxdomain_storm') then 'd' when signal in ('rare_ja3', 'tls_no_sni_external', 'sni_ip_mismatch') then 't' end as e, score, severity, peer, "count",
    row_number() over (partition by session_id, device, e order by score desc, first_ts, peer desc) as r from sig where device <> ''),
  w1 as (select session_id, device, e, severity || ':' || "count" || ':' || peer as v, score from w where r = 1 and e is not null),
  fu as (select session_id, device, {rdd('least(1.0, base * boost)', 3)} as fusion, len(string_split(techniques, ';')) as nt from risk where device <> '')
  select fu.session_id, fu.device, fusion, nt as techniques, (select v from w1 where e = 'b' and w1.session_id = fu.session_id and w1.device = fu.device) as beaconing, (select v from w1 where e = 'd' and w1.session_id = fu.session_id and w1.device = fu.device) as dns_tunneling,
  (select v from w1 where e = 't' and w1.session_id = fu.session_id and w1.device = fu.device) as tls_anomaly from fu""")
def _(spark, d):
    s = signals(spark, d)
    a = E.advanced_signals_by_ip(s, E.kill_chain_fusion(s, window_s=900_000))
    t = lambda c: F.expr(f"{c}.severity || ':' || {c}.count || ':' || {c}.peer").alias(c)
    return a.select("session_id", "device", F.col("fusion_score.score").alias("fusion"), F.col("fusion_score.techniques").alias("techniques"),
                    t("beaconing"), t("dns_tunneling"), t("tls_anomaly"))


@C.add("e13_signal_fp_report", SIGNALS_SQL + """, eng as (select *, case when starts_with(signal, 'arp') or signal = 'rogue_dhcp' then 'arp_dhcp' when signal in ('dns_tunneling', 'nxdomain_storm') then 'dns_tunnel' when signal = 'dga_domain' then 'dga' when signal = 'beaconing' then 'beaconing' else 'tls' end as engine from sig),
  ga as (select distinct session_id, ip_src as ip from packets where dhcp_sid is not null or tls_cipher = '0x0005')
  select session_id, engine, count(*) as n_signals, count(distinct device) filter (device <> '') as n_devices, count(distinct device) filter ((session_id, device) in (select (session_id, ip) from ga)) as tp,
  count(distinct device) filter (device <> '' and (session_id, device) not in (select (session_id, ip) from ga where ip is not null)) as fp, """ + rdd("max(score)", 2) + """ as top_score from eng group by all""")
def _(spark, d):
    truth = packets(spark, d).where("dhcp_sid is not null or tls_cipher = '0x0005'").select("session_id", F.col("ip_src").alias("ip")).where("ip is not null")
    return E.signal_fp_report(signals(spark, d), truth)


# ---- windows ----------------------------------------------------------------------------------

@C.add("w01_inter_arrival", W + f"""select session_id, ip_src, {rd('ts')} as ts, {rd('prev')} as prev_ts, {rd('ts - prev')} as gap from (select session_id, ip_src, ts,
  lag(ts) over (partition by session_id, ip_src order by ts) as prev from packets where ip_src is not null)""")
def _(spark, d):
    p = packets(spark, d).where("ip_src is not null").select("session_id", "ip_src", "ts")
    return common.gaps(p, ["session_id", "ip_src"])


@C.add("w02_max_distinct_in_window", W + """, ev2 as (select session_id, ip_src, ts, proto from packets where ip_src is not null),
  k as (select a.session_id, a.ip_src, a.ts, count(distinct b.proto) as k from ev2 a join ev2 b on a.session_id = b.session_id and a.ip_src = b.ip_src and b.ts between a.ts - 36000 and a.ts group by all)
  select session_id, ip_src, max(k) as best from k group by all""")
def _(spark, d):
    p = packets(spark, d).where("ip_src is not null")
    return common.max_distinct_in_window(p, ["session_id", "ip_src"], "ts", "proto", 36000)


@C.add("w02_quantiles", f"with {FLOWS_SQL} select session_id, ip_src, {rd('quantile_cont(cast(len as double), 0.25)')} as q25, {rd('quantile_cont(cast(len as double), 0.5)')} as q50, {rd('quantile_cont(cast(len as double), 0.95)')} as q95 from flows group by all")
def _(spark, d):
    f = flows(spark, d)
    return common.quantiles(f, ["session_id", "ip_src"], "len", (0.25, 0.5, 0.95), ("q25", "q50", "q95"), rows=f.count())
