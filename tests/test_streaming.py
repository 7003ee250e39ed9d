"""State that ends, late rows, and live tables folded batch by batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from packetloom.operators import features as A
from packetloom.streaming import live as L
from packetloom.streaming.folds import LiveTables, _ones, _written, default_folds, host_features
from packetloom.streaming.state import ENDED, NEW, item_totals, live_items, session_totals

T0 = 3600 * 472_222

ARP = dict(arp_psrc="10.0.0.7", arp_hwsrc="aa")


def packet(ts, src="10.0.0.1", dst="10.0.0.2", **more):
    return dict(ts=str(float(T0 + ts)), ip_src=src, ip_dst=dst, eth_src=more.pop("mac", "m1"), proto=more.pop("proto", "TCP"), **more)


def run(spark, make, batches, transform, mode):
    """Feeds the batches one by one and returns the rows of each micro-batch and the progress reports."""
    feed, got = tempfile.mkdtemp(prefix="feed-"), []
    schema = make([packet(0)]).schema
    for b in batches:
        make(b).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    q = (transform(stream).writeStream.outputMode(mode).foreachBatch(lambda df, e: got.append(df.collect()))
         .option("checkpointLocation", tempfile.mkdtemp(prefix="state-")).trigger(availableNow=True).start())
    q.awaitTermination()
    return got, q.recentProgress


HOURS = [[packet(3600 * h + i, src=f"10.0.{h}.{i}", mac=f"m{h}{i % 3}") for i in range(20)] + [packet(3600 * h + 30, src="10.9.9.9")] for h in range(5)]
LATE = [packet(5, src="10.8.8.8", mac="late", proto="LATE")]


def test_items_are_exact_and_late_rows_do_not_count(spark, make):
    got, progress = run(spark, make, [*HOURS, LATE], lambda s: live_items(s, ["session", "device", "mac", "protocol"], idle_s=7200, parts=4), "update")
    changes = spark.createDataFrame([r for b in got for r in b])
    row = session_totals(item_totals(changes)).first()
    assert (row.packets, row.devices, row.macs, row.protocols) == (105, 101, 16, 1)
    assert row.last_ms == (T0 + 3600 * 4 + 30) * 1000
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) > 0
    assert {r.item for b in got for r in b if r.kind == "device" and r.state == NEW} == {p["ip_src"] for h in HOURS for p in h}


def test_state_falls_after_the_watermark(spark, make):
    got, progress = run(spark, make, HOURS, lambda s: live_items(s, ["device"], idle_s=1800, parts=4), "update")
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # Without an end 101 devices would be held.
    assert max(sizes) < 80 and sizes[-1] < max(sizes)
    ended = {r.item for b in got for r in b if r.state == ENDED}
    assert {p["ip_src"] for p in HOURS[0][:20]} <= ended and not any(p["ip_src"] in ended for p in HOURS[4])
    changes = spark.createDataFrame([r for b in got for r in b])
    assert item_totals(changes).where("item = '10.9.9.9'").first().packets == 5


def test_pairs_come_once_a_life(spark, make):
    batches = [[packet(0, **ARP), packet(1, **ARP)], [packet(60, **ARP), packet(61, arp_psrc="0.0.0.0", arp_hwsrc="bb")], [packet(9000)], [packet(9100)], [packet(9200, **ARP)]]
    batches = [[{**p, "ip_src": "", "ip_dst": ""} for p in b] for b in batches]
    got, _ = run(spark, make, batches, lambda s: L.live_arp_pairs(s, idle_s=600, watermark="1 minute"), "update")
    assert [(r.ip, r.mac, r.first_ms) for b in got for r in b] == [("10.0.0.7", "aa", T0 * 1000), ("10.0.0.7", "aa", (T0 + 9200) * 1000)]


def test_window_features_are_exact_and_leave_no_state(spark, make):
    batches = [*HOURS, [packet(3600 * 9, src="end")], LATE]
    got, progress = run(spark, make, batches, lambda s: L.live_ip_features(s.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", "10 minutes"), window="1 hour"), "append")
    rows = {(r.window_start.timestamp(), r.ip): r for b in got for r in b}
    want = {(T0 + 3600.0 * h, p["ip_src"]) for h in range(5) for p in HOURS[h]}
    assert set(rows) == want and all(r.unique_dsts == 1 for r in rows.values())
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_segments_of_a_binary_counter():
    held = set()
    for n in range(1, 200):
        held = (held | set(_written(n - 1)))
        assert set(_ones(n)) <= held and len(_ones(n)) == bin(n).count("1")
        assert sorted(_ones(n))[0][0] == 0 and sum(b - a for a, b in _ones(n)) == n
    assert sum(len(_written(n)) for n in range(256)) < 2 * 256


def test_live_tables_equal_the_batch_and_read_only_new_packets(spark, make):
    batches = [[packet(100 * b + i, src=f"10.0.0.{i % 5}", dst=f"10.1.{i % 3}.{b % 4}", len=str(60 + 7 * i + b), tcp_flags="0x0002" if i % 2 else "", dns_qname="a.example." if i == 3 else "")
                for i in range(12)] for b in range(9)]
    batches[4] = []
    tables = LiveTables(spark, tempfile.mkdtemp(prefix="tables-"), default_folds(), watermark_s=600)
    schema = make([packet(0)]).schema
    for e, b in enumerate(batches):
        df = make(b) if b else spark.createDataFrame([], schema)
        if e == 5:
            tables.step(df, e)  # a batch that fails after its work is given again
        tables.step(df, e)
        held = {n.split("=")[1] for n in os.listdir(f"{tables.folder}/pairs") if n.startswith("segment=")}
        needed = {f"{a}-{z}" for n in (e, e + 1) for a, z in _ones(n)} | {f"{a}-{z}" for a, z in _written(e)}
        assert held <= needed and {f"{a}-{z}" for a, z in _ones(e + 1)} <= held
        assert len(os.listdir(f"{tables.folder}/arrived")) <= 2
        files = tables.segments("pairs", e + 1).inputFiles()
        assert len({os.path.dirname(f) for f in files}) <= len(_ones(e + 1))
    all_ = make([p for b in batches for p in b])
    key = lambda r: (r.session_id, r.ip)
    got, want = (sorted((r for r in x.collect()), key=key) for x in (host_features(tables.table("pairs", 9)), A.ip_features(all_)))
    assert len(got) == len(want) == 5
    for g, w in zip(got, want, strict=True):
        assert {c: pytest.approx(v) for c, v in w.asDict().items()} == g.asDict()
    assert tables.state(9)["rows"] == 96 and tables.state(9)["late"] == 0
    tables.step(make([packet(1, src="10.7.7.7"), packet(900)]), 9)
    assert tables.state(10) == {"rows": 98, "late": 1, "newest": T0 + 900.0}
    assert tables.table("pairs", 10).where("ip = '10.7.7.7'").isEmpty()
    sketch = tables.table("devices", 10).select(F.hll_sketch_estimate("sketch").alias("n"), "packets").first()
    assert (sketch.n, sketch.packets) == (5, 97)


def test_a_sum_of_squares_keeps_its_digits(spark, make):
    rows = [packet(i, len=str(10**9 + i % 2)) for i in range(1000)]
    folds = default_folds()
    std = host_features(folds["pairs"].partial(make(rows))).first().std_len
    assert std == pytest.approx(A.ip_features(make(rows)).first().std_len) == pytest.approx(0.50025, abs=1e-4)


def test_the_feed_is_derived_once(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    from catalog import live

    derived = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(ts):
        derived.add(1)
        return ts

    one = live.raw_packets_from_events
    monkeypatch.setattr(live, "raw_packets_from_events", lambda s, d: one(s, d).withColumn("ts", seen("ts")))
    monkeypatch.setattr(live, "_text", {})
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.read.text(live.feed_folder(spark, sf)).count() == rows + 1 and derived.value == rows
