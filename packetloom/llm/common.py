"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z in lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words a worker remembers before it starts anew; bounds its memory.
CACHED_WORDS = 400_000
#: Setting by which Spark removes the shuffle files of a query when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder the session was given. One of our own
    only where both are unset and there is one machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_folder()
    return found.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="packetloom-llm-")


def staged_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again; survives lost executors, unlike cached rows. The shuffle files of
    the write are freed with it instead of when the driver next collects garbage."""
    path = staged_path(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with _freed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_by_worker(key: Hashable, make: Callable[[], object]) -> object:
    """What `make` gives, kept by the Python worker for the next tasks it runs. Functions arrive anew with every task, so their own
    module cannot hold it."""
    holder = sys.modules.setdefault("_packetloom_worker", types.ModuleType("_packetloom_worker"))
    kept = holder.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Returns memory that this Python worker has freed to the system. Workers live on and idle beside the next steps, and what Arrow and
    the C library hold back (150 MB and more) counts as the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, with a worker that gives back its free memory at the end of a task and, unless `run` keeps things itself,
    forgets at the start what another step had it keep."""

    def leaner(batches: Iterator) -> Iterator:
        if not keeps and "_packetloom_worker" in sys.modules:
            sys.modules["_packetloom_worker"].__dict__.get("kept", {}).clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaner


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for short words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(values: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Order-dependent 64-bit hash of every run of n values."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    b = np.uint64(base)
    for i in range(n):
        out *= b
        out += values[i:i + count]
    return mix(out)


def mix(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of SplitMix64)."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b''."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def runs_of(batch: pa.RecordBatch, name: str = "text", most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in runs of bounded size, with the row each run begins at. Only the texts of one run are held as Python
    objects; a larger text is a run by itself."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = np.cumsum(pc.coalesce(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most_bytes, side="right")))
        yield lo, texts(batch.slice(lo, hi - lo), name)
        lo = hi


def batches_of(schema: pa.Schema, rows: Iterable[dict], most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from dicts that may hold large binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if size >= most_bytes or len(held) >= most_rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def signed(v: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(v).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node that can be reached.

    Alternates between linking larger neighbours and linking smaller neighbours to the least one, until nothing changes. Every
    round is groupings with partial minima and equality joins; no component is gathered anywhere. Each round is staged.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def _close(pairs: DataFrame, need: int, of: int, plausible) -> DataFrame:
    """Candidate pairs, each once, whose sizes and number of shared keys allow the similarity."""
    pairs = pairs.where(of * F.least("size_a", "size_b") >= need * F.greatest("size_a", "size_b"))
    shared = pairs.groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("weight").alias("shared"))
    return shared.where(plausible(F.col("shared")))


def _labelled(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The groups with each member's component, without those that lie in one component."""
    roots = components(found).withColumnRenamed("node", "sig")
    out = groups.drop("root").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    mixed = out.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid")
    return stage(out.join(mixed, "gid", "left_semi"))


def _stars(groups: DataFrame, order: str) -> DataFrame:
    """(member, hub) pairs of every group whose members are not in the hub's component yet."""
    hub = groups.groupBy("gid").agg(F.min_by(F.struct("sig", "size", "root"), F.expr(order)).alias("hub"))
    pairs = groups.join(hub, "gid").where("root <> hub.root")
    return _ordered(pairs.select(F.col("sig").alias("a"), F.col("hub.sig").alias("b"), F.col("size").alias("size_a"), F.col("hub.size").alias("size_b"), "weight"))


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
                        F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"), "weight")


def _across(groups: DataFrame, need: int, of: int) -> DataFrame:
    """All pairs of members of a group that are in different components of fitting sizes; pairs inside a component are never formed."""
    classes = groups.groupBy("gid", "root").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    one, other = (classes.select("gid", *[F.col(c).alias(c + k) for c in ("root", "lo", "hi")]) for k in "12")
    fits = (of * F.col("hi1") >= need * F.col("lo2")) & (of * F.col("hi2") >= need * F.col("lo1"))
    two = one.join(other.withColumnRenamed("gid", "_gid"), (F.col("gid") == F.col("_gid")) & (F.col("root1") < F.col("root2")) & fits)
    two = two.select("gid", F.col("root1").alias("r1"), F.col("root2").alias("r2"))
    one = groups.select("gid", F.col("root").alias("r1"), F.col("sig").alias("a"), F.col("size").alias("size_a"), "weight")
    other = groups.select("gid", F.col("root").alias("r2"), F.col("sig").alias("b"), F.col("size").alias("size_b"))
    pairs = two.join(one, ["gid", "r1"]).join(other, ["gid", "r2"])
    return _ordered(pairs)


def connect(groups: DataFrame, verify, need: int, of: int, plausible=lambda shared: F.lit(True)) -> DataFrame:
    """Links (a, b) that connect what all similar pairs inside the groups connect.

    groups: gid, sig, size, weight, where similar nodes share at least one group; verify keeps the similar ones of pairs (a, b,
    size_a, size_b), and plausible tells from the weights of all groups that a pair shares whether it can be similar. Three rounds
    compare each member with one hub of its group, which costs as many pairs as a group has members; there a pair's groups under
    other hubs are not counted, so half the weight does. The first hub is the member that shares the most with others, which in a
    family of copies is their source or close to it. No pair is verified twice. Then all pairs between members of a group that are still in different
    components are compared, so that no link between them is missed.
    """
    found = tried = None
    members = groups.groupBy("gid").agg((F.count("*") - 1).alias("others"))
    degree = groups.join(members, "gid").groupBy("sig").agg(F.sum(F.col("weight") * F.col("others")).alias("degree"))
    groups = stage(groups.join(degree, "sig"))
    for order in ("struct(-degree, sig)", "sig", "xxhash64(sig)", ""):
        groups = groups.withColumn("root", F.col("sig")) if found is None else _labelled(groups, found)
        if found is not None and groups.isEmpty():
            break
        pairs = _stars(groups, order) if order else _across(groups, need, of)
        close = _close(pairs, need, of, (lambda n: plausible(2 * n)) if order else plausible)
        close = stage(close if tried is None else close.join(tried, ["a", "b"], "left_anti"))
        more = stage(verify(close))
        found = more if found is None else found.unionByName(more)
        tried = close.select("a", "b") if tried is None else tried.unionByName(close.select("a", "b"))
    return found
