"""Live tables as sums of partial aggregates. A batch is reduced to its partials, which are merged like a binary counter: after n
batches there are as many segments as n has ones in binary, so a batch is written about log2(n) times in all and a snapshot reads
few segments. No packet is kept or read twice."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import flag_class, strip_trailing_dots, tcp_flag_int

FLAGS = ("syn", "rst", "fin", "null", "xmas")


@dataclass(frozen=True)
class Fold:
    """Rows, their keys, and per measure how a batch makes it and how two partials merge."""

    rows: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    measures: Mapping[str, tuple[Callable[[], Column], Callable[[str], Column]]]

    def partial(self, packets: DataFrame) -> DataFrame:
        return self.rows(packets).groupBy(*self.keys).agg(*[make().alias(n) for n, (make, _) in self.measures.items()])

    def merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[join(n).alias(n) for n, (_, join) in self.measures.items()])


def _count() -> Column:
    return F.count(F.lit(1))


def default_folds(by=("session_id",)) -> dict[str, Fold]:
    """Partials of what the live view shows: talker pairs, which give the host features, and the counters and sets."""
    has = lambda c: F.col(c).isNotNull()
    size = lambda: F.col("_size")

    def pairs(p: DataFrame) -> DataFrame:
        return p.where(has("ip_src")).select(
            *by, F.col("ip_src").alias("ip"), "ip_dst", F.when(has("ip_dst"), F.col("len")).alias("_size"),
            F.when(has("tcp_flags"), tcp_flag_int(F.col("tcp_flags"))).alias("_flags"))

    flag = lambda c: lambda: F.count_if(flag_class(F.col("_flags"), c))
    square = lambda: F.sum((F.col("_size") * F.col("_size")).cast("decimal(19,0)")).cast("decimal(38,0)")
    add = lambda n: F.sum(n)
    add_decimal = lambda n: F.sum(n).cast("decimal(38,0)")
    n = {"n": (_count, add)}

    def arp(p: DataFrame) -> DataFrame:
        return p.where(has("arp_psrc") & has("arp_hwsrc") & (F.col("arp_psrc") != "0.0.0.0")).select(*by, F.col("arp_psrc").alias("ip"), F.col("arp_hwsrc").alias("mac"))

    def dns(p: DataFrame) -> DataFrame:
        name = strip_trailing_dots(F.col("dns_qname"))
        return p.where(F.length(name) > 3).select(*by, name.alias("qname"))

    return {
        "pairs": Fold(pairs, (*by, "ip", "ip_dst"), {
            "count": (lambda: F.count(size()), add), "total_bytes": (lambda: F.coalesce(F.sum(size()), F.lit(0).cast("bigint")), add),
            "squares": (lambda: F.coalesce(square(), F.lit(0).cast("decimal(38,0)")), add_decimal), **{f"{c}_count": (flag(c), add) for c in FLAGS}}),
        "macs": Fold(lambda p: p.where(has("eth_src")).select(*by, F.col("eth_src").alias("mac")), (*by, "mac"), n),
        "protocols": Fold(lambda p: p.where(has("proto")).select(*by, "proto"), (*by, "proto"), n),
        "arp": Fold(arp, (*by, "ip", "mac"), n),
        "dns": Fold(dns, (*by, "qname"), n),
        "devices": Fold(lambda p: p.where(has("ip_src")), tuple(by), {
            "packets": (_count, add), "sketch": (lambda: F.hll_sketch_agg("ip_src", 14), lambda c: F.hll_union_agg(c))}),
    }


def sample_deviation(count: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from exact integer sums; NULL below two values. With the whole mean q and the rest r of the total, the
    squares less q * total less q * r are exact, and only r * r / count is rounded."""
    n = F.when(count > 1, count)
    q, r = F.call_function("div", total, n), F.pmod(total, n)
    wide = lambda c: c.cast("decimal(19,0)")
    exact = squares - wide(q) * wide(total) - wide(q) * wide(r)
    return F.sqrt((exact.cast("double") - r.cast("double") * r / n) / (n - 1))


def host_features(pairs: DataFrame, *, by=("session_id",), keep=None) -> DataFrame:
    """The columns of the batch features from talker pairs, each of them once; a pair is a destination, so counting pairs counts them exactly.
    ``keep`` names the grouping columns where ``by`` has expressions."""
    keep = list(keep or by)
    flags = [f"{c}_count" for c in FLAGS]
    std = F.coalesce(sample_deviation(F.col("count"), F.col("total_bytes"), F.col("squares")), F.lit(0.0))
    sums = pairs.groupBy(*by, "ip").agg(
        F.sum("count").alias("count"), F.sum("total_bytes").alias("total_bytes"), F.sum("squares").alias("squares"), F.count("ip_dst").alias("unique_dsts"),
        *[F.sum(c).alias(c) for c in flags]).where(F.col("count") > 0).withColumn("std_len", std)
    return sums.select(
        *keep, "ip", "count", "total_bytes", (F.col("total_bytes") / F.col("count")).alias("mean_len"), "std_len", "unique_dsts",
        (F.col("count") / (F.col("std_len") + 1)).alias("burst_score"), (F.col("count") + F.col("total_bytes") / 1000).alias("dominance"), *flags)


def _ones(n: int) -> list[tuple[int, int]]:
    """[start, end) of the segments after n batches: the powers of two that n is made of, the oldest the largest."""
    out, at = [], 0
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            out.append((at, at + (1 << bit)))
            at += 1 << bit
    return out


def _written(epoch: int) -> list[tuple[int, int]]:
    """The segments that a batch writes: its own, and each that it completes by merging with the one before of the same width."""
    out = [(epoch, epoch + 1)] if epoch >= 0 else []
    while out and (out[-1][0] // (out[-1][1] - out[-1][0])) % 2:
        start, end = out[-1]
        out.append((2 * start - end, end))
    return out


class LiveTables:
    """Tables folded batch by batch into a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, folds: Mapping[str, Fold], *, watermark_s: float = 600.0):
        self.spark, self.folder, self.folds, self.watermark_s = spark, folder.rstrip("/"), dict(folds), watermark_s

    def _segment(self, name: str, span: tuple[int, int]) -> str:
        return f"{self.folder}/{name}/segment={span[0]}-{span[1]}"

    def _log(self, epoch: int) -> str:
        return f"{self.folder}/epochs/epoch={epoch}"

    def state(self, epochs: int) -> dict:
        """Rows, late rows and the newest event time after so many batches."""
        if epochs == 0:
            return {"rows": 0, "late": 0, "newest": None}
        return json.loads(self.spark.read.text(self._log(epochs - 1)).first()[0])

    def step(self, packets: DataFrame, epoch: int) -> None:
        """Takes up one batch. It reads that batch once and, where segments merge, only partials. Rows older than the watermark of the
        batches before are counted by an observation and left out. A batch that is repeated writes the same segments again."""
        before = self.state(epoch)
        late = F.lit(False) if before["newest"] is None else F.col("ts") < before["newest"] - self.watermark_s
        seen = Observation()
        watched = packets.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"), F.max("ts").alias("newest"))
        rows = f"{self.folder}/arrived/epoch={epoch}"
        # The batch is read once: what all folds need of it is written for the time of the batch.
        watched.where(~late).write.mode("overwrite").parquet(rows)
        batch = self.spark.read.schema(packets.schema).parquet(rows)
        for name, fold in self.folds.items():
            own, *merged = _written(epoch)
            fold.partial(batch).write.mode("overwrite").parquet(self._segment(name, own))
            for start, end in merged:
                middle = (start + end) // 2
                both = self.spark.read.parquet(self._segment(name, (start, middle)), self._segment(name, (middle, end)))
                fold.merge(both).write.mode("overwrite").parquet(self._segment(name, (start, end)))
        newest = [t for t in (before["newest"], seen.get["newest"]) if t is not None]
        log = {"rows": before["rows"] + seen.get["rows"], "late": before["late"] + seen.get["late"], "newest": max(newest, default=None)}
        self.spark.createDataFrame([(json.dumps(log),)], "value string").coalesce(1).write.mode("overwrite").text(self._log(epoch))
        self._forget(epoch)

    def _forget(self, epoch: int) -> None:
        """Removes the packets of the batch before, and the segments that neither this state nor the one before it consists of."""
        needed = {*_ones(epoch + 1), *_ones(epoch)}
        gone = [f"{self.folder}/arrived/epoch={epoch - 1}"] if epoch else []
        for span in {*_ones(max(epoch - 1, 0)), *_written(epoch - 1)} - needed:
            gone += [self._segment(name, span) for name in self.folds]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in gone:
            path(p).getFileSystem(conf).delete(path(p), True)

    def segments(self, name: str, epochs: int) -> DataFrame:
        """The partials of a table after so many batches. The last two states are kept."""
        return self.spark.read.parquet(*[self._segment(name, s) for s in _ones(epochs)])

    def table(self, name: str, epochs: int) -> DataFrame:
        return self.folds[name].merge(self.segments(name, epochs))

    def start(self, packets: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = packets.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
