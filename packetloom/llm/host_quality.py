"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior, joined back to the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import WordHashes, lean, runs_of, stage, windows

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _points(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def repeated_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    grams = windows(hashes, width)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(hashes) + 1, np.int64)
    hit = np.zeros(len(grams), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(starts, at, 1)
    np.add.at(starts, at + width, -1)
    return int(np.count_nonzero(np.cumsum(starts)[:-1] > 0))


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        out: list[list[int]] = [[], [], [], [], []]
        for raw in (x for _, run in runs_of(batch, "_text") for x in run):
            words = raw.split()
            found = (len(words), _points(raw.translate(None, SPACES)), len(raw) - len(raw.translate(None, SYMBOLS)),
                     duplicate_lines(raw), repeated_words(hashes.of(words)))
            for column, value in zip(out, found, strict=True):
                column.append(value)
        kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_text"]
        names = [f.name for f in batch.schema if f.name != "_text"]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(c, pa.int64()) for c in out], names + list(COUNTS))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), host: str = "source") -> DataFrame:
    """Counts over every whole text: one row per input row with `keep` and the host as `_host`. Null text counts as empty."""
    given = docs.select(*keep, F.col(host).cast("string").alias("_host"), F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text"), *(f"{c} bigint" for c in COUNTS)])
    out = given.mapInArrow(lean(_measure), schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: rows, failures of each rule, and the failure rate shrunk towards the rate of all hosts.

    The prior is a beta distribution fitted by moments to the hosts' rates, less the variance that the hosts' sizes explain. Rows
    without a host share one.
    """
    hosts = measured.groupBy("_host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"),
        F.sum((F.col("n_words") < 20).cast("long")).alias("n_short"),
        F.sum((100 * F.col("n_repeat_words") > 30 * F.col("n_words")).cast("long")).alias("n_repeating"))
    hosts = stage(hosts)
    p = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("h"), F.avg(p).alias("mean"),
                      F.var_pop(p).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    mean = (total.f or 0) / total.n if total.n else 0.0
    spread = max((total.var or 0.0) - mean * (1 - mean) * (total.inv or 0.0), 0.0)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 0 else 1e4 if mean * (1 - mean) > 0 else 1.0
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def assess(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), host: str = "source", max_rate: float = 0.9) -> DataFrame:
    """Every row with its counts, its host's shrunk failure rate and `kept`.

    A row is kept if it passes the rules itself and its host's shrunk rate is at most `max_rate`. The default turns a host down only
    when nearly all it has fails, so clean rows of a mixed host stay. One row comes out per row that goes in: repeated rows and
    ties each get the same verdict, null and empty texts fail (no words), and an empty table gives an empty one. Only `keep`, the
    host and the text are read, so further columns cannot clash.
    """
    measured = stage(measure(docs, text, keep, host))
    return _judged(measured, host_rates(measured), max_rate)


def _judged(measured: DataFrame, rates: DataFrame, max_rate: float) -> DataFrame:
    rates = rates.select(F.col("_host").alias("_of"), "shrunk_rate")
    out = measured.join(rates, F.col("_host").eqNullSafe(F.col("_of")), "left").drop("_of")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("shrunk_rate") <= max_rate)).withColumnRenamed("_host", "host")


def clean(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.9) -> DataFrame:
    """The documents without those that the rules or their host's verdict reject, all columns kept, whatever their names.

    The texts are measured twice, once for the rates and once with the rows, so that no text is stored or shuffled for the rates.
    """
    rates = host_rates(measure(docs, text, (), host))
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"), F.col(host).alias("host"))
    return _judged(measure(rows, "text", ("_row",), "host"), rates, max_rate).where("kept").select("_row.*")
