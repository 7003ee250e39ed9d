"""Benchmark decontamination as a prefix-filtered set join of documents with the windows of benchmark items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import texts

#: A-Z in lower case; a-z, digits and all bytes over 127 as they are; the rest parts words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WIDTH = 10
#: Benchmark texts of at most so many bytes are sent to the executors at once; more go in several blocks, one pass each.
BLOCK_BYTES = 32 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


class WindowIndex:
    """The distinct windows of a block of items, filed under their rarest word.

    A window is contained in a document only if all its words are, so one necessary prefix token in the order of rarity does. The
    token's place in the window fixes where the window would have to start, which bounds the candidates by position and length.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], rarity: dict[bytes, int]):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int | None]] = {}
        for item, raw in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(raw)]
            for i in range(max(1, len(ids) - WIDTH + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + WIDTH]), set()).add(item)
        names = list(self.vocabulary)
        rank = np.array([rarity.get(w, 0) for w in names], np.int64)
        self.items = list(found.values())
        self.windows = np.full((len(found), WIDTH), -2, np.int64)
        under = np.zeros(len(found), np.int64)
        self.offset = np.zeros(len(found), np.int64)
        for k, ids in enumerate(found):
            self.windows[k, :len(ids)] = ids
            self.offset[k] = min(range(len(ids)), key=lambda i: (rank[ids[i]], names[ids[i]], i))
            under[k] = ids[self.offset[k]]
        self.length = (self.windows >= 0).sum(axis=1)
        self.filed = np.argsort(under, kind="stable")
        counts = np.bincount(under, minlength=len(names)) if len(names) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def occurrences(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence in an array of word ids that ends in a gap of -1."""
        n = np.where(flat >= 0, self.first[flat + 1] - self.first[np.maximum(flat, 0)], 0)
        at = np.repeat(np.arange(len(flat)), n)
        if not len(at):
            return at, at
        which = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + self.first[flat[at]]
        window = self.filed[which]
        start = at - self.offset[window]
        fits = (start >= 0) & (start + WIDTH <= len(flat))
        start, window = start[fits], window[fits]
        good = np.ones(len(start), bool)
        for i in range(WIDTH):
            want = self.windows[window, i]
            good &= (want == -2) | (flat[start + i] == want)
        return start[good], window[good]


def _flat(vocabulary: dict[bytes, int], raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all texts with gaps of -1 between them, where each text starts, and how many words each has."""
    pieces, sizes = [], []
    for raw in raws:
        words = words_of(raw)
        pieces.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words)))
        pieces.append(np.full(WIDTH, -1, np.int64))
        sizes.append(len(words))
    n = np.array(sizes, np.int64)
    return (np.concatenate(pieces) if pieces else np.empty(0, np.int64)), np.cumsum(n + WIDTH) - n - WIDTH, n


def word_rarity(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """(word, df): how many rows hold each word of the items, over all documents. Counted per task first, then summed."""
    wanted = items.select(F.col(item_text).alias("text"))

    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for raw in texts(batch) for w in words_of(raw)}), pa.binary())], ["word"])

    vocabulary = wanted.mapInArrow(split, "word binary").distinct()
    held = [r.word for r in vocabulary.collect()] if _bytes(wanted) <= BLOCK_BYTES else None
    if held is None:
        def every(batches):
            for batch in batches:
                for raw in texts(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(set(words_of(raw))), pa.binary())], ["word"])

        counts = docs.select(F.col(text).alias("text")).mapInArrow(every, "word binary").groupBy("word").agg(F.count("*").alias("df"))
        return counts.join(vocabulary, "word", "left_semi")
    ids = docs.sparkSession.sparkContext.broadcast({bytes(w): i for i, w in enumerate(held)})

    def count(batches):
        total = np.zeros(len(ids.value), np.int64)
        for batch in batches:
            for raw in texts(batch):
                words = words_of(raw)
                got = np.fromiter(map(ids.value.get, words, repeat(-1)), np.int64, len(words))
                got = np.unique(got)
                total[got[got >= 0]] += 1
        names, some = list(ids.value), np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.binary()), pa.array(total[some])], ["word", "df"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, df bigint").groupBy("word").agg(F.sum("df").alias("df"))


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size, in order of a hash."""
    total = _bytes(items)
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item_id, (r.text or "").encode()) for r in rows.collect()]


def find(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of docs with `keep`, n_words, n_hit, spans (word from, word to) and the items whose windows occur.

    Whole texts are searched. The items are sent in blocks of at most BLOCK_BYTES of text; each further block is one more narrow pass
    over the same rows, so nothing is shuffled and no size breaks it. Null and empty texts have no words and no hits; items without
    words have no window; equal items are each reported; repeated documents each get a row; of empty tables either gives no hits.
    """
    items = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    rows = docs.select(F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    rows = rows.withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
                             "items": F.expr("cast(array() as array<bigint>)")})
    spark, schema = docs.sparkSession, rows.schema
    rarity = word_rarity(docs, items, text)
    for block in _blocks(items):
        wanted = spark.createDataFrame([(w,) for w in sorted({w for _, raw in block for w in words_of(raw)})], "word binary")
        known = {bytes(r.word): r.df for r in rarity.join(wanted, "word", "left_semi").collect()}
        index = spark.sparkContext.broadcast(vars(WindowIndex(block, known)))
        rows = rows.mapInArrow(_search(index), schema)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("_keep.*", "n_words", hit.alias("n_hit"), "spans", "items")


def _search(index):
    def search(batches):
        found = WindowIndex.__new__(WindowIndex)
        vars(found).update(index.value)
        for batch in batches:
            raws = texts(batch, "_text")
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            sizes: list[int] = []
            for lo, hi in _runs(raws):
                flat, first, n = _flat(found.vocabulary, raws[lo:hi])
                sizes.extend(n.tolist())
                start, window = found.occurrences(flat)
                if len(start):
                    doc = np.searchsorted(first, start, side="right") - 1
                    order = np.lexsort((start, doc))
                    cut = np.flatnonzero(np.diff(doc[order])) + 1
                    for part in np.split(order, cut):
                        d = int(doc[part[0]])
                        here = (start[part] - first[d]).tolist()
                        new = list(zip(here, (start[part] - first[d] + found.length[window[part]]).tolist(), strict=True))
                        spans[lo + d] = _merged([(s["start"], s["end"]) for s in spans[lo + d]] + new)
                        items[lo + d] = sorted({*items[lo + d], *(i for w in set(window[part].tolist()) for i in found.items[w] if i is not None)})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, batch.schema.field(3).type),
                                              pa.array(items, batch.schema.field(4).type)], batch.schema.names)

    return search


def _runs(raws: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for hi, raw in enumerate(raws):
        if size and size + len(raw) > most:
            yield lo, hi
            lo, size = hi, 0
        size += len(raw)
    if raws:
        yield lo, len(raws)


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def remove(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns, whatever these are called."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"))
    return find(rows, items, keep=("_row",)).where("n_hit = 0").select("_row.*")
