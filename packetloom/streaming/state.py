"""Exact live counters per device, address, protocol, name or pair, kept in state that ends.

Every packet gives some (kind, item) facts. They are counted inside each input batch first, so a protocol that every packet has
costs a row per batch of rows; then map state per (session, kind, part of the items) takes them up. Event-time timers end the items
that were quiet for ``idle``, so state follows what is alive and not what was ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import strip_trailing_dots

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NEW, SEEN, ENDED = "new", "seen", "ended"


def require_state_store(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB store, which keeps state on disk; it is chosen where none is."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def _pair(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b.cast("string")))


def facts_of(kinds: Sequence[str]) -> Column:
    """Array of (kind, item) of a packet, item NULL where it has none."""
    arp = F.when(F.col("arp_psrc") != "0.0.0.0", _pair(F.col("arp_psrc"), F.col("arp_hwsrc")))
    name = strip_trailing_dots(F.col("dns_qname"))
    items = {
        "session": [F.lit("")], "device": [F.col("ip_src")], "mac": [F.col("eth_src")], "protocol": [F.col("proto")], "arp": [arp],
        "dns": [F.when(F.length(name) > 3, name)],
        "port": [_pair(F.col("ip_src"), F.col(c)) for c in ("tcp_sport", "tcp_dport", "udp_sport", "udp_dport")],
    }
    return F.array(*[F.struct(F.lit(k).alias("kind"), item.alias("item")) for k in kinds for item in items[k]])


def _count_batches(by: Sequence[str]):
    keys = [*by, "kind", "part", "minute", "item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(keys).aggregate([("len", "count"), ("len", "sum"), ("at", "min"), ("at", "max")])
            out = sums.select([*keys, "len_count", "len_sum", "at_min", "at_max"]).rename_columns([*keys, "packets", "bytes", "first_at", "event_time"])
            yield from out.drop_columns(["minute"]).combine_chunks().to_batches()

    return run


def item_counts(packets: DataFrame, kinds: Sequence[str], *, by=("session_id",), watermark: str = "10 minutes", parts: int = 64) -> DataFrame:
    """Facts counted inside each batch of rows by minute, with the watermark of their last event. Late rows share no minute with rows
    in time but for the one in which the watermark lies."""
    fact = F.explode(facts_of(kinds)).alias("fact")
    at = F.timestamp_seconds("ts")
    rows = packets.select(*by, at.alias("at"), "len", fact).where("fact.item is not null").select(
        *by, "fact.kind", F.pmod(F.xxhash64("fact.item"), F.lit(parts)).cast("int").alias("part"), F.date_trunc("minute", "at").alias("minute"), "fact.item",
        F.coalesce("len", F.lit(0).cast("bigint")).alias("len"), "at")
    types = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", kind string, part int, item string, packets bigint, bytes bigint, first_at timestamp, event_time timestamp"
    return rows.mapInArrow(_count_batches(by), schema).withWatermark("event_time", watermark)


class _Items(StatefulProcessor):
    """State of one (session, kind, part): what is known of each live item, and when to look for quiet ones."""

    def __init__(self, columns: list[str], idle_ms: int, changes: bool):
        self.columns, self.idle_ms, self.changes = columns, idle_ms, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "life bigint, packets bigint, bytes bigint, first_ms bigint, last_ms bigint")
        self.alarm = handle.getValueState("alarm", "at_ms bigint")

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key[:-1], *r) for r in rows], columns=self.columns)

    def _set_alarm(self, at_ms: int) -> None:
        self.handle.registerTimer(at_ms)
        self.alarm.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}
        for pdf in rows:
            first, last = (pdf[c].astype("datetime64[us]").astype("int64") // 1000 for c in ("first_at", "event_time"))
            for item, n, size, lo, hi in zip(pdf["item"], pdf["packets"], pdf["bytes"], first, last):
                if (held := found.get(item)) is None:
                    found[item] = [int(n), int(size), int(lo), int(hi)]
                else:
                    held[:] = held[0] + int(n), held[1] + int(size), min(held[2], int(lo)), max(held[3], int(hi))
        out = []
        for item, (n, size, lo, hi) in found.items():
            known = self.items.getValue((item,))
            if known is None:
                value, state = (lo, n, size, lo, hi), NEW
            else:
                value, state = (known[0], known[1] + n, known[2] + size, min(known[3], lo), max(known[4], hi)), SEEN
            self.items.updateValue((item,), value)
            if state == NEW or self.changes:
                out.append((item, state, *value))
        if found and not self.alarm.exists():
            self._set_alarm(min(v[3] for v in found.values()) + self.idle_ms)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        live, out = [], []
        for (item,), value in list(self.items.iterator()):
            if value[4] + self.idle_ms <= now:
                self.items.removeKey((item,))
                out.append((item, ENDED, *value))
            else:
                live.append(value[4])
        self.alarm.clear()
        if live:
            # Half of idle later at the earliest, so that looking through the items stays rare.
            self._set_alarm(max(min(live) + self.idle_ms, now + self.idle_ms // 2))
        if out and self.changes:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def live_items(packets: DataFrame, kinds: Sequence[str], *, by=("session_id",), idle_s: float = 3600.0, watermark: str = "10 minutes", parts: int = 64,
               changes: bool = True) -> DataFrame:
    """Of a stream of normalised packets, which sets its own watermark here: a row for every item that a micro-batch brings, with its counters so far, and one when it ends; with ``changes`` off only its
    first row. An item that comes back after its end starts a new life, told apart by ``life``. For output mode update."""
    require_state_store(packets.sparkSession)
    by = list(by)
    # Each packet is a fact of its session, so time goes on for the state of kinds that are rare.
    counted = item_counts(packets, list(dict.fromkeys(["session", *kinds])), by=by, watermark=watermark, parts=parts)
    types = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    names = [*by, "kind", "item", "state", "life", "packets", "bytes", "first_ms", "last_ms"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", kind string, item string, state string, life bigint, packets bigint, bytes bigint, first_ms bigint, last_ms bigint"
    found = counted.groupBy(*by, "kind", "part").transformWithStateInPandas(
        _Items(names, round(idle_s * 1000), changes), schema, "Update", "EventTime")
    return found.where(F.col("kind").isin(list(kinds)))


def item_totals(changes: DataFrame, *, by=("session_id",)) -> DataFrame:
    """Counters of every item over all its lives, from the change rows that a sink has kept. Counters only grow in a life, so repeated
    rows and rows in any order give the same."""
    lives = changes.groupBy(*by, "kind", "item", "life").agg(F.max("packets").alias("packets"), F.max("bytes").alias("bytes"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    return lives.groupBy(*by, "kind", "item").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def session_totals(items: DataFrame, *, by=("session_id",)) -> DataFrame:
    """Packets, bytes, distinct devices, MACs and protocols of a session, from the totals of its items."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    all_ = F.col("kind") == "session"
    return items.groupBy(*by).agg(
        F.sum(F.when(all_, F.col("packets"))).alias("packets"), F.sum(F.when(all_, F.col("bytes"))).alias("bytes"), of("device").alias("devices"),
        of("mac").alias("macs"), of("protocol").alias("protocols"), F.max(F.when(all_, F.col("last_ms"))).alias("last_ms"))
