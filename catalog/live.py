"""Text scans, sinks and streams over packets written out as delimited text."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from packetloom.operators import features as A
from packetloom.session import ensure_checkpoint_dir, staged
from packetloom.sources import tables as S
from packetloom.sources.adapters import raw_packets_from_events
from packetloom.sources.packets import normalize_packets, read_packet_list, read_packets, stream_packets
from packetloom.sources.schema import BASE_FIELDS, LIVE_FIELDS
from packetloom.streaming import live as L
from packetloom.streaming import state as ST
from packetloom.streaming.folds import LiveTables, default_folds, host_features

from .base import FEATURES_SQL, Catalog, packets, rd, rdd, stored, table
from .detection import SIGNALS_SQL_R, signals
from .features import W

C = Catalog()

# The text export has no session column: all packets are one session there.
ONE = FEATURES_SQL.replace("case when epoch_us < 1705363200000000 then 'S1' else 'S2' end as session_id", "'S1' as session_id")
W1 = f"with {ONE} "
assert ONE != FEATURES_SQL

#: Packets of a file of the feed, at least, where a part of it has several.
FEED_ROWS = 100_000

_text: dict[tuple[str, str], str] = {}
_files: dict[str, int] = {}


def _fresh(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_folder(spark, d) -> str:
    """Pipe-delimited export of the derived packets in two folders, written once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _text:
        path = _fresh(spark, "export")
        # Derived once by all tasks; only the finished lines go through the one task of a file.
        lines = staged(raw_packets_from_events(spark, d).select("packet_id", F.concat_ws("|", *BASE_FIELDS).alias("value")))
        for name, odd in (("a", 0), ("b", 1)):
            lines.where(F.col("packet_id") % 2 == odd).select("value").coalesce(1).write.text(f"{path}/{name}")
        _text[key] = path
    return _text[key]


def feed_folder(spark, d) -> str:
    """The packets as a live feed, in its field order: five parts in order of time, then one with a packet that is days late. Each of
    the five is as many files (`feed_files`), which as many tasks write; a stream takes one part after the other."""
    key = (spark.sparkContext.applicationId, d, "feed")
    if key not in _text:
        path = _fresh(spark, "feed")
        raw = staged(raw_packets_from_events(spark, d).select(F.concat_ws("|", *LIVE_FIELDS).alias("value"), F.col("ts").cast("double").alias("_at")))
        cuts = [float("-inf"), *raw.stat.approxQuantile("_at", [0.2, 0.4, 0.6, 0.8], 0.01), float("inf")]
        files = max(1, raw.count() // (5 * FEED_ROWS))
        for lo, hi in zip(cuts, cuts[1:]):
            part = raw.where((F.col("_at") > lo) & (F.col("_at") <= hi)).select("value")
            (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").text(path)
        late = {"ts": str(raw.agg(F.min("_at")).first()[0]), "len": "60", "eth_src": "02:99:99:99:99:99", "ip_src": "10.99.99.99", "ip_dst": "10.99.99.98", "proto": "LATE",
                "dns_qname": "late.example", "arp_psrc": "10.99.99.99", "arp_hwsrc": "02:99:99:99:99:99", "tcp_sport": "9"}
        spark.createDataFrame([("|".join(late.get(c, "") for c in LIVE_FIELDS),)], "value string").coalesce(1).write.mode("append").text(path)
        _text[key] = path
        _files[path] = files
    return _text[key]


def feed_files(spark, d) -> int:
    """Files of each part of the feed but the last, which is one file."""
    return _files[feed_folder(spark, d)]


def _collect_stream(spark, stream, mode: str):
    """Run a stream over what is there and return its result as a table: the last one in mode complete, else all rows of all batches
    with the number of their batch."""
    path = _fresh(spark, "stream")

    def keep(df, epoch):
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = (stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", _fresh(spark, "state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(path)


def _raw_feed(spark, d):
    return stream_packets(spark, feed_folder(spark, d), max_files_per_trigger=feed_files(spark, d), session="S1")


def _feed(spark, d):
    return L.live_packets(_raw_feed(spark, d))


def _items(spark, d):
    """Change rows of the live counters, once per application: several queries look at them."""
    changes = stored(spark, d, "live_items", lambda: _collect_stream(spark, ST.live_items(normalize_packets(_raw_feed(spark, d)), ["session", "device", "mac", "protocol", "dns"]), "update"))
    return ST.item_totals(changes)


def _tables(spark, d):
    """Live tables folded over the feed, and the number of batches."""
    key = (spark.sparkContext.applicationId, d, "tables")
    if key not in _text:
        _text[key] = _fresh(spark, "tables")
        _live_tables(spark, _text[key]).start(normalize_packets(_raw_feed(spark, d)), _fresh(spark, "state")).awaitTermination()
    return _live_tables(spark, _text[key]), 6


def _live_tables(spark, folder):
    return LiveTables(spark, folder, default_folds())


@C.add("s01_read_packets", W1 + f"select case when packet_id % 2 = 0 then 'a' else 'b' end as folder, {rd('ts')} as ts, len, ip_src, ip_dst, proto, tcp_dport, dns_qname, dns_response, tls_sni from packets")
def _(spark, d):
    path = text_folder(spark, d)
    p = normalize_packets(read_packets(spark, [f"{path}/a", f"{path}/b"]))
    return p.select(F.element_at(F.split("session_id", "/"), -2).alias("folder"), "ts", "len", "ip_src", "ip_dst", "proto", "tcp_dport", "dns_qname", "dns_response", "tls_sni")


@C.add("s05_write_field_index", W + "select session_id, year(make_timestamp(cast(floor(ts * 1000000) as bigint))) as year, month(make_timestamp(cast(floor(ts * 1000000) as bigint))) as month, count(*) as n, cast(sum(len) as bigint) as bytes from packets group by all")
def _(spark, d):
    path = _fresh(spark, "index")
    S.write_field_index(packets(spark, d), path)
    S.write_field_index(packets(spark, d).where("session_id = 'S2'"), path)
    return S.read_field_index(spark, path).groupBy("session_id", "year", "month").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@C.add("s06_export_stats", W + f"select session_id, count(*) as rows, {rd('max(ts) - min(ts)')} as duration_s from packets group by all")
def _(spark, d):
    return S.export_stats(packets(spark, d)).select("session_id", "rows", "duration_s")


@C.add("s07_write_results", f"with {FEATURES_SQL} select session_id, ip, \"count\", total_bytes from features")
def _(spark, d):
    root = _fresh(spark, "results")
    f = A.ip_features(packets(spark, d))
    S.write_results({"ip_features": f}, root)
    S.write_results({"ip_features": f.where("session_id = 'S1'")}, root)
    return S.read_results(spark, root, "ip_features").select("session_id", "ip", "count", "total_bytes")


@C.add("s11_t05_tumbling_series", W1 + f"""select cast(floor(ts / 300) as bigint) * 300 as window_start, count(*) as packets, cast(sum(len) as bigint) as bytes, {rd('avg(len)')} as mean_size from packets where ip_src is not null and ip_dst is not null group by window_start having window_start + 300 <= (select max(ts) - 600 from packets)""")
def _(spark, d):
    out = _collect_stream(spark, L.tumbling_series(_feed(spark, d), "5 minutes"), "append")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "packets", "bytes", "mean_size")


@C.add("t01_live_totals", W1 + f"select session_id, count(*) as packets, cast(sum(len) as bigint) as bytes, count(distinct ip_src) as devices, count(distinct eth_src) as macs, count(distinct proto) as protocols, {rd('floor(max(ts) * 1000) / 1000', 3)} as last_ts from packets group by all")
def _(spark, d):
    return ST.session_totals(_items(spark, d)).withColumn("last_ts", F.col("last_ms") / 1000).drop("last_ms")


@C.add("t01_live_top_talkers", W1 + "select ip_src, count(*) as packets, cast(sum(len) as bigint) as bytes from packets where ip_src is not null group by all order by packets desc, ip_src limit 5")
def _(spark, d):
    t = _items(spark, d).where("kind = 'device'").withColumnRenamed("item", "ip_src")
    return t.orderBy(F.desc("packets"), F.asc("ip_src")).limit(5).select("ip_src", "packets", "bytes")


@C.add("t01_live_protocols", W1 + f"select session_id, proto, count(*) as packets, cast(sum(len) as bigint) as bytes, {rd('floor(min(ts) * 1000) / 1000', 3)} as first_ts from packets where proto is not null group by all")
def _(spark, d):
    t = _items(spark, d).where("kind = 'protocol'")
    return t.select("session_id", F.col("item").alias("proto"), "packets", "bytes", (F.col("first_ms") / 1000).alias("first_ts"))


_CLOSED = "having count(*) filter (ip_dst is not null) > 0 and window_start + 86400 <= (select max(ts) - 600 from packets)"


@C.add("t02_live_ip_features", W1 + f"""select cast(floor(ts / 86400) as bigint) * 86400 as window_start, ip_src as ip, count(*) filter (ip_dst is not null) as "count", cast(sum(len) filter (ip_dst is not null) as bigint) as total_bytes,
  {rd('avg(len) filter (ip_dst is not null)')} as mean_len, {rd('coalesce(stddev_samp(len) filter (ip_dst is not null), 0.0)')} as std_len, count(distinct ip_dst) as unique_dsts,
  count(*) filter (tcp_flags is not null and fi & 63 = 2) as syn_count, count(*) filter (tcp_flags is not null and fi & 4 <> 0) as rst_count, count(*) filter (tcp_flags is not null and fi & 63 = 1) as fin_count,
  count(*) filter (tcp_flags is not null and fi & 63 = 0) as null_count, count(*) filter (tcp_flags is not null and fi & 63 = 41) as xmas_count from flagged where ip_src is not null group by window_start, ip_src {_CLOSED}""")
def _(spark, d):
    out = _collect_stream(spark, L.live_ip_features(_feed(spark, d), window="1 day"), "append")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "ip", "count", "total_bytes", "mean_len", "std_len", "unique_dsts",
                      "syn_count", "rst_count", "fin_count", "null_count", "xmas_count")


@C.add("t03_live_arp_pairs", W1 + "select distinct arp_psrc as ip, arp_hwsrc as mac from packets where arp_psrc is not null and arp_hwsrc is not null and arp_psrc <> '0.0.0.0'")
def _(spark, d):
    # As long as the recording: each pair has one life and comes once.
    return _collect_stream(spark, L.live_arp_pairs(normalize_packets(_raw_feed(spark, d)), idle_s=1e8), "update").select("ip", "mac")


@C.add("t03_live_ports", W1 + """, po as (select ip_src as ip, unnest([tcp_sport, tcp_dport, udp_sport, udp_dport]) as port from packets where ip_src is not null) select distinct ip, port from po where port is not null""")
def _(spark, d):
    return _collect_stream(spark, L.live_ports(normalize_packets(_raw_feed(spark, d)), idle_s=1e8), "update").select("ip", "port")


@C.add("t03_live_dns_counts", W1 + "select rtrim(dns_qname, '.') as qname, count(*) as n from packets where length(rtrim(dns_qname, '.')) > 3 group by all")
def _(spark, d):
    return _items(spark, d).where("kind = 'dns'").select(F.col("item").alias("qname"), F.col("packets").alias("n"))


@C.add("t04_snapshot_equals_batch", W1 + f"select ip, \"count\", total_bytes, {rd('mean_len')} as mean_len, {rd('std_len')} as std_len, unique_dsts, syn_count, rst_count, fin_count, null_count, xmas_count from features")
def _(spark, d):
    tables, n = _tables(spark, d)
    return host_features(tables.table("pairs", n)).select("ip", "count", "total_bytes", "mean_len", "std_len", "unique_dsts", "syn_count", "rst_count", "fin_count", "null_count", "xmas_count")


@C.add("t04_live_tables", W1 + """select 'macs' as name, eth_src as item, count(*) as n from packets where eth_src is not null group by all union all select 'protocols', proto, count(*) from packets where proto is not null group by all
  union all select 'arp', arp_psrc || ' ' || arp_hwsrc, count(*) from packets where arp_psrc <> '0.0.0.0' and arp_hwsrc is not null group by all
  union all select 'dns', rtrim(dns_qname, '.'), count(*) from packets where length(rtrim(dns_qname, '.')) > 3 group by all""")
def _(spark, d):
    tables, n = _tables(spark, d)
    item = {"macs": F.col("mac"), "protocols": F.col("proto"), "arp": F.concat_ws(" ", "ip", "mac"), "dns": F.col("qname")}
    parts = [tables.table(name, n).select(F.lit(name).alias("name"), i.alias("item"), "n") for name, i in item.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@C.add("t04_live_arrivals", W1 + f"select count(*) + 1 as rows, 1::bigint as late, {rd('max(ts)')} as newest from packets")
def _(spark, d):
    tables, n = _tables(spark, d)
    return spark.createDataFrame([tables.state(n)], "rows bigint, late bigint, newest double")


@C.add("t06_sliding_fusion", SIGNALS_SQL_R + f""", sl as (select session_id, device, score, technique, unnest(range(cast(floor(first_ts / 60) as bigint) * 60 - 840, cast(floor(first_ts / 60) as bigint) * 60 + 1, 60)) as window_start from sig)
  select window_start, session_id, device, count(*) as signals, {rdd('max(score)', 3)} as max_score, {rdd('least(1.0, max(score) * (1 + 0.5 * (count(distinct technique) - 1)))', 3)} as risk, string_agg(distinct technique, ';' order by technique) as techniques from sl group by all""")
def _(spark, d):
    rows = signals(spark, d)
    path = _fresh(spark, "signal-feed")
    # Five files in order of time, a batch each; a window that a batch changes comes again, the last time counts.
    rows = stored(spark, d, "signal_rows", lambda: rows)
    cuts = [float("-inf"), *rows.stat.approxQuantile("first_ts", [0.2, 0.4, 0.6, 0.8], 0.01), float("inf")]
    for lo, hi in zip(cuts, cuts[1:]):
        rows.where((F.col("first_ts") > lo) & (F.col("first_ts") <= hi)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = _collect_stream(spark, L.sliding_fusion(stream), "update")
    last = Window.partitionBy("window_start", "session_id", "device").orderBy(F.desc("epoch"))
    out = out.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "epoch")
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@C.add("t07_dedup_chunks", "select distinct sha256(concat('u', cast(user_id as string))) as sha256 from events")
def _(spark, d):
    rows = table(spark, d, "events").select(F.sha2(F.concat(F.lit("u"), F.col("user_id").cast("string")), 256).alias("sha256"), F.col("ts").cast("timestamp").alias("received_at"))
    path = _fresh(spark, "uploads")
    rows.repartitionByRange(5, "received_at").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _collect_stream(spark, L.dedup_chunks(stream), "append").select("sha256")


@C.add("t08_within_duration", W1 + f"select {rd('ts')} as ts, len, ip_src from packets where ts <= 1704067207.0 + 86400.0")
def _(spark, d):
    return _collect_stream(spark, L.within_duration(_feed(spark, d).where("proto is distinct from 'LATE'"), 1704067207.0, 86400.0), "append").select("ts", "len", "ip_src")


@C.add("s04_read_packet_list", """select event_id as "No", case when event_id % 5 = 0 then 0.0 else floor(value) end as "Time", case when event_id % 7 = 0 then 0 else user_id end as "Length", case when event_id % 3 = 0 then '' else 'Où ' || event_type end as "Info" from events""")
def _(spark, d):
    path = _fresh(spark, "packet-list")
    table(spark, d, "events").selectExpr(
        "event_id as `No`", "case when event_id % 5 = 0 then 'bad' else cast(floor(value) as string) end as `Time`",
        "case when event_id % 7 = 0 then '' else cast(user_id as string) end as `Length`",
        "case when event_id % 3 = 0 then null else concat('Où ', event_type) end as `Info`").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_packet_list(spark, path).select(F.col("No").cast("bigint").alias("No"), "Time", "Length", "Info")


@C.add("s10_read_verdict_archive", """select 'session:S' || conv_id % 2 || ':10.0.0.' || conv_id as source, 'Session S' || conv_id % 2 || ' (c' || conv_id || '.pcap, recorded 2024-01-01). IP 10.0.0.' || conv_id || ' was judged benign - category dns_amp, confidence 0.5. '
  || case when conv_id % 3 = 0 then 'Device: Acme h' || conv_id || '. ' else '' end || 'Triggered by: scan_rule. Reasoning: r' || turn as text from conversations""")
def _(spark, d):
    path = _fresh(spark, "archive")
    docs = table(spark, d, "conversations").selectExpr(
        "concat('S', conv_id % 2) as session_id", "named_struct('time_range', array('2024-01-01'), 'original_filename', concat('c', conv_id, '.pcap')) as context",
        "array(named_struct('candidate_id', concat('10.0.0.', conv_id), 'verdict', named_struct('verdict', 'benign', 'category', 'dns_amp', 'confidence', 0.5D, 'reasoning', concat('r', turn)), "
        "'evidence', named_struct('device', case when conv_id % 3 = 0 then named_struct('vendor', 'Acme', 'hostname', concat('h', conv_id)) end, 'trigger_reasons', array('scan_rule')))) as results")
    docs.write.partitionBy("session_id").json(path)
    return S.read_verdict_archive(spark, path, pattern="*/*.json", multi_line=False).select("source", "text")
