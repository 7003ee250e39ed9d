"""Derive packet-shaped tables from the star-schema test tables, by integer arithmetic and text only.

Every expression is plain SQL understood by Spark and by other engines, so that an independent check can
derive the same rows. ``epoch_us`` is the one column each engine computes its own way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .packets import normalize_packets

_E, _U, _K = "event_id", "user_id", "k"
_V = "cast(floor(value) as bigint)"
_PRIV = "concat('10.0.', cast(cast(floor(user_id / 200) as bigint) as string), '.', cast(user_id % 200 + 1 as string))"
_PRIV2 = "concat('192.168.', cast(k % 3 as string), '.', cast(event_id % 50 + 1 as string))"
_PUB = ("concat(case k % 4 when 0 then '52.10.' when 1 then '142.250.' when 2 then '157.240.' else '203.7.' end, "
        "cast(k % 7 as string), '.', cast(event_id % 40 + 1 as string))")
_MAC = "concat('02:00:5e:00:', lpad(cast(user_id % 90 + 10 as string), 2, '0'), ':', lpad(cast(k % 2 as string), 2, '0'))"
_MAC_U = ("concat(case user_id % 4 when 0 then '3c:5a:b4' when 1 then 'a4:83:e7' when 2 then '00:1b:63' else '06:11:22' end, "
          "':00:', lpad(cast(user_id % 90 + 10 as string), 2, '0'), ':01')")
_CONS = f"translate(substr(md5(cast({_E} % 400 as string)), 1, 12), '0123456789abcdef', 'bcdfghjkmnpqrstv')"
_SITE = ("case k % 12 when 0 then 'www.youtube.com' when 1 then 'mail.google.com' when 2 then 'api.slack.com' "
         "when 3 then 'd111.cloudfront.net' when 4 then 'www.facebook.com' when 5 then 'ocsp.digicert.com' "
         "when 6 then 'www.bbc.co.uk' when 7 then 'cdn.example.org' when 8 then 'shop.example.com.au' "
         "when 9 then 'www.netflix.com.' when 10 then 'wpad.home.lan' else 'news.example.net' end")
_DNS_NAME = (f"case when k < 15 then concat(substr(md5(cast({_E} as string)), 1, 20), '.t', cast(k % 3 as string), '-tunnel.com') "
             f"when k < 35 then concat({_CONS}, '.net') when k < 80 then {_SITE} "
             f"when k < 88 then concat('device', cast({_U} % 30 as string), '.local') "
             f"when k < 91 then concat('1.0.', cast(k as string), '.10.in-addr.arpa') "
             f"when k < 95 then concat(md5(cast({_E} as string)), md5(cast({_U} as string)), '.long.example.org') "
             f"when k < 97 then '10.0.0.local' else '_airplay._tcp.local' end")

_IS_DNS = "event_type = 'view'"
_IS_RESP = f"{_IS_DNS} and event_id % 3 = 0"
_IS_TCP = "event_type = 'click'"
_IS_TLS = "event_type = 'purchase'"
_IS_ARP = "event_type = 'signup' and event_id % 3 = 0"
_IS_UDP = "event_type = 'signup' and event_id % 3 = 1"
_IS_DHCP = "event_type = 'signup' and event_id % 3 = 2"
_IS_WLAN = "event_type = 'error' and event_id % 4 = 0"
_IS_PLAIN = "event_type = 'error' and event_id % 4 = 1"
_IS_RST = "event_type = 'error' and event_id % 4 >= 2"
_IS_V6 = "user_id % 11 = 10"
_NO_IP = f"(({_IS_ARP}) or ({_IS_WLAN}))"

# Raw (all-text) packet columns over (event_id, user_id, event_type, value, k, epoch_us).
PACKET_EXPRESSIONS = {
    "session_id": "case when epoch_us < 1705363200000000 then 'S1' else 'S2' end",
    "packet_id": "event_id",
    "ts_us": f"case when {_IS_UDP} then epoch_us - epoch_us % 3600000000 else epoch_us end",
    "len": f"case when event_id % 97 = 0 then 'n/a' when {_IS_UDP} then '120' when {_IS_RESP} then cast(150 + 4 * {_V} as string) else cast(60 + {_V} as string) end",
    "eth_src": f"case when event_id % 17 = 0 then '' when event_id % 5 = 0 then {_MAC} else {_MAC_U} end",
    "eth_dst": "case when event_id % 2 = 0 then 'ff:ff:ff:ff:ff:ff' else '3c:5a:b4:00:00:01' end",
    "ip_src": f"case when {_NO_IP} then '' when {_IS_RESP} then concat('8.8.', cast(k % 4 as string), '.8') when {_IS_V6} and event_id % 4 <> 0 then '' when event_id % 9 = 4 then {_PUB} else {_PRIV} end",
    "ip_dst": f"case when {_NO_IP} or event_id % 41 = 0 then '' when {_IS_RESP} or event_id % 9 = 4 then {_PRIV} when {_IS_UDP} then concat('198.100.', cast(user_id % 3 as string), '.9') when event_id % 3 = 0 then {_PUB} when event_id % 4 = 1 then '8.8.8.8' else {_PRIV2} end",
    "ip6_src": f"case when {_IS_V6} and not {_NO_IP} then concat('fd00::', cast(user_id as string)) else '' end",
    "ip6_dst": f"case when {_IS_V6} and not {_NO_IP} then concat('2600:9000::', cast(k as string)) else '' end",
    "proto": f"case when {_IS_DNS} then 'DNS' when {_IS_TLS} then 'TLSv1.2' when {_IS_ARP} then 'ARP' when {_IS_UDP} then 'UDP' when {_IS_DHCP} then 'DHCP' when {_IS_WLAN} then '802.11' when {_IS_PLAIN} and event_id % 8 = 1 then 'FTP' when {_IS_PLAIN} then 'SMTP' else 'TCP' end",
    "tcp_sport": f"case when {_IS_TCP} or {_IS_TLS} or {_IS_RST} then cast(40000 + event_id % 500 as string) when {_IS_PLAIN} then '50021' else '' end",
    "tcp_dport": f"case when {_IS_TLS} then '443' when {_IS_PLAIN} and event_id % 8 = 1 then '21' when {_IS_PLAIN} then '25' when {_IS_TCP} or {_IS_RST} then case k % 10 when 0 then '80' when 1 then '443' when 2 then '22' when 3 then '8080' when 4 then '9100' when 5 then '62078' when 6 then '1883' when 7 then '5060' when 8 then cast(1000 + k as string) else '445' end else '' end",
    "tcp_flags": f"case when {_IS_TCP} then case event_id % 8 when 3 then '0x0010' when 4 then '0x0001' when 5 then '0x0000' when 6 then '0x0029' when 7 then '0x00c2' else '0x0002' end when {_IS_RST} then case when k % 7 = 0 then 'zz' else '0x0014' end when {_IS_TLS} then '0x0018' when {_IS_PLAIN} then '0x0018' else '' end",
    "udp_sport": f"case when {_IS_RESP} then '53' when {_IS_DNS} then cast(30000 + k as string) when {_IS_UDP} then '45000' when {_IS_DHCP} then '67' else '' end",
    "udp_dport": f"case when {_IS_RESP} then cast(30000 + k as string) when {_IS_DNS} and event_id % 13 = 0 then '5300' when {_IS_DNS} and k >= 80 then '5353' when {_IS_DNS} then '53' when {_IS_UDP} then '4444' when {_IS_DHCP} then '68' else '' end",
    "dns_qname": f"case when {_IS_DNS} then {_DNS_NAME} else '' end",
    "dns_qtype": f"case when {_IS_DNS} then case k % 3 when 0 then '1' when 1 then '28' else '16' end else '' end",
    "dns_rcode": f"case when {_IS_RESP} then case when k % 4 = 0 then '3' else '0' end else '' end",
    "dns_response": f"case when {_IS_RESP} then case event_id % 2 when 0 then '1' else 'True' end when {_IS_DNS} then case event_id % 2 when 0 then '0' else 'False' end else '' end",
    "arp_psrc": f"case when {_IS_ARP} then case when k % 20 = 0 then '0.0.0.0' when k % 20 = 1 then '10.0.0.1' else {_PRIV} end else '' end",
    "arp_hwsrc": f"case when {_IS_ARP} then case when k % 25 = 0 then 'ff:ff:ff:ff:ff:ff' else {_MAC} end else '' end",
    "arp_opcode": f"case when {_IS_ARP} then case when user_id % 3 = 0 or k % 2 = 1 then '2' else '1' end else '' end",
    "arp_pdst": f"case when {_IS_ARP} then '10.0.0.254' else '' end",
    "http_host": f"case when {_IS_TCP} and k % 10 = 0 then {_SITE} else '' end",
    "tls_sni": f"case when {_IS_TLS} and event_id % 6 <> 0 then {_SITE} else '' end",
    "tls_ja3": f"case when {_IS_TLS} and event_id % 7 <> 0 then case when event_id % 50 = 3 then md5(cast(event_id as string)) else md5(cast(k % 9 as string)) end else '' end",
    "tls_ja4": "''",
    "tls_version": f"case when {_IS_TLS} then case k % 6 when 0 then '0x0300' when 1 then '0x0301' when 2 then '0x0303' when 3 then '0x0304' when 4 then '0x0303' else '0x7f1c' end else '' end",
    "tls_cipher": f"case when {_IS_TLS} then case k % 5 when 0 then '0x1301' when 1 then '0x000A' when 2 then '0x0005' when 3 then '0xc02f' else '' end else '' end",
    "dhcp_sid": f"case when {_IS_DHCP} then case when k % 10 = 0 then '10.0.0.66' else '10.0.0.1' end else '' end",
    "wlan_type": f"case when {_IS_WLAN} then cast(k % 3 as string) else '' end",
    "wlan_subtype": f"case when {_IS_WLAN} then cast(k % 13 as string) else '' end",
    "wlan_sa": f"case when {_IS_WLAN} then upper({_MAC_U}) else '' end",
    "wlan_retry": f"case when {_IS_WLAN} then cast(k % 2 as string) else '' end",
    "rssi_radiotap": f"case when {_IS_WLAN} and k % 3 <> 0 then concat('-', cast(30 + event_id % 50 as string), ',-90') else '' end",
    "rssi_wlanradio": f"case when {_IS_WLAN} and k % 2 = 0 then concat('-', cast(35 + event_id % 40 as string)) else '' end",
    "wlan_bssid": f"case when {_IS_WLAN} then case when k % 5 = 0 then 'bad' else concat('AA:BB:CC:00:00:0', cast(k % 4 as string)) end else '' end",
    "wlan_ssid": f"case when {_IS_WLAN} then case when k % 7 = 0 then '' else concat('net-', cast(k % 6 as string)) end else '' end",
    "payload": f"case when {_IS_PLAIN} and event_id % 8 = 1 then concat(' ', case k % 4 when 0 then 'USER alice' when 1 then 'PASS secret' when 2 then 'LIST' else 'STOR file' end, ' ', md5(props), md5(props), md5(props)) when {_IS_PLAIN} then concat(case k % 3 when 0 then 'MAIL FROM:<a@b.example>' when 1 then 'EHLO host' else 'x RCPT TO:<c@d.example> DATA' end, ' ') else '' end",
}


def raw_packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The test table is one small file: spread its rows before the text is derived.
    events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(spark.sparkContext.defaultParallelism)
    base = (events
            .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
            .withColumn("epoch_us", F.unix_micros(F.col("ts").cast("timestamp"))))
    cols = [F.expr(e).alias(n) for n, e in PACKET_EXPRESSIONS.items()]
    return base.select(*cols).withColumn("ts", (F.col("ts_us") / F.lit(1000000.0)).cast("string")).drop("ts_us")


_written: dict[tuple[str, str], str] = {}


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised packet table as Parquet by session, derived once per application.

    This is how captures are meant to be kept: typed, '' already NULL, so that the filters and column lists of
    the operators reach the scan. The files go to the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        root = f"{ensure_checkpoint_dir(spark)}/derived-{uuid.uuid4().hex}"
        raw_packets_from_events(spark, sf_dir).write.parquet(f"{root}/raw")
        silver = normalize_packets(spark.read.parquet(f"{root}/raw"))
        silver.write.partitionBy("session_id").parquet(f"{root}/packets")
        _written[key] = f"{root}/packets"
    return spark.read.parquet(_written[key])


def flows_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume table: supplier as source, part as destination, price as bytes, ship date as time."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    suffix = "concat(cast(cast(floor({0} / 250) as bigint) as string), '.', cast({0} % 250 as string))"
    flags = ("case l_linenumber % 6 when 0 then '0x0010' when 1 then '0x0002' when 2 then '0x0018' "
             "when 3 then '0x0001' when 4 then '0x0014' else '0x00c2' end")
    return li.select(
        F.expr("case when l_returnflag = 'N' then 'S2' else 'S1' end").alias("session_id"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"),
        F.expr("cast(floor(l_extendedprice) as bigint)").alias("len"),
        F.expr("concat('10.1.', " + suffix.format("l_suppkey") + ")").alias("ip_src"),
        F.expr("concat('52.2.', " + suffix.format("l_partkey") + ")").alias("ip_dst"),
        F.expr(flags).alias("tcp_flags"),
        F.lit("TCP").alias("proto"),
    ).withColumn("ts", F.col("us") / F.lit(1000000.0)).drop("us")
