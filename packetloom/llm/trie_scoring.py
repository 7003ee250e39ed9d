"""Language-model scoring with n-gram tries in Elias-Fano levels.

The corpus is cut into blocks of bounded size. A block sends each shard of the vocabulary its distinct words and word pairs with
their training counts; a shard owns a range of word hashes, as words and as contexts. It merges the counts, builds its trie and
answers every block's words and pairs from it. The answers go back to the blocks, where they become probabilities of documents.
"""

from __future__ import annotations

import json
import math
import mmap
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import LOWER, WordHashes, batches_of, partitions, stage, texts

#: Tokens of a block; bounds a task's memory.
BLOCK = 2_000_000
#: Code points of text per shard of the model, on average.
SHARD_CHARS = 8_000_000
#: Absolute discount of a seen pair, whose mass goes to the words by themselves.
DISCOUNT = 0.75
#: Successors are told apart inside their context by the upper 40 bits of their hashes.
FP_BITS = 40
#: Quantised negative log10 values are steps of 1/4096; the last code means none.
STEP, NONE = 4096, 65535
START = xxhash.xxh3_64_intdigest(b" start")
END = xxhash.xxh3_64_intdigest(b" end")


class EliasFano:
    """A non-decreasing sequence: the lower bits of each value side by side, the upper ones in unary as a bit string."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low = n, low_bits, low
        self.mask = np.uint64((1 << low_bits) - 1)
        # The upper parts of the values, from the places of the bits.
        self.high = (np.flatnonzero(np.unpackbits(high, bitorder="little")) - np.arange(n)).astype(np.uint64)
        self.words = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,)) if len(low) >= 8 else np.empty(0, "<u8")

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        if not n:
            return 0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8)
        low_bits = max(0, min(57, int(math.log2((int(values[-1]) + 1) / n))))
        rows = 1 << 16  # a multiple of 8, so that parts join at bytes
        low = [np.packbits(np.unpackbits(values[i:i + rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits].ravel(), bitorder="little")
               for i in range(0, n, rows)] if low_bits else []
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1, np.uint8)
        bits[high] = 1
        return n, low_bits, np.concatenate([*low, np.zeros(8, np.uint8)]), np.packbits(bits, bitorder="little")

    def access(self, at: np.ndarray) -> np.ndarray:
        return (self.high[at] << np.uint64(self.low_bits)) | self._low(at)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted value, -1 if it is missing: halving among the values whose upper part is the wanted one."""
        upper, lower = wanted >> np.uint64(self.low_bits), wanted & self.mask
        at, end = np.searchsorted(self.high, upper), np.searchsorted(self.high, upper, side="right")
        out = np.full(len(wanted), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        last = end.copy()
        while len(open_):
            middle = (at[open_] + end[open_]) >> 1
            less = self._low(middle) < lower[open_]
            at[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < end[open_]]
        some = np.flatnonzero(at < last)
        some = some[self._low(at[some]) == lower[some]]
        out[some] = at[some]
        return out


class Trie:
    """One shard: words, and under each its successors, in levels that are memory-mapped from one file."""

    LEVELS = ("words", "pointers", "successors")
    ARRAYS = {"counts": "<u4", "backoff": "<u2", "probability": "<u2"}

    def __init__(self, raw):
        size = int.from_bytes(raw[:8], "little")
        self.head = json.loads(bytes(raw[8:8 + size]))
        at = 8 + size + -size % 8
        self.parts = {}
        for name, (kind, n) in self.head["parts"].items():
            self.parts[name] = np.frombuffer(raw, kind, n, at)
            at += self.parts[name].nbytes + -self.parts[name].nbytes % 8
        for name in self.LEVELS:
            n, low_bits = self.head["levels"][name]
            setattr(self, name, EliasFano(n, low_bits, self.parts[f"{name}.low"], self.parts[f"{name}.high"]))
        self.base = self.head["base"]

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie from a file that has no name any more and goes with the map."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, context: np.ndarray, successor: np.ndarray, pair_counts: np.ndarray, discount: float = DISCOUNT) -> bytes:
        """From sorted words with their counts, and pairs sorted by (place of the context, successor) with theirs."""
        n_pairs = np.bincount(context, minlength=len(words)).astype(np.int64)
        total = np.bincount(context, weights=pair_counts, minlength=len(words))
        seen = total > 0
        backoff = np.full(len(words), NONE, "<u2")
        backoff[seen] = quantised(discount * n_pairs[seen] / total[seen])
        base = int(words[0]) if len(words) else 0
        levels = {"words": words - np.uint64(base), "pointers": np.concatenate([[0], np.cumsum(n_pairs)]).astype(np.uint64),
                  "successors": (context.astype(np.uint64) << np.uint64(FP_BITS)) | successor}
        arrays = {"counts": counts.astype("<u4"), "backoff": backoff, "probability": quantised((pair_counts - discount) / total[context])}
        sizes = {}
        for name, values in levels.items():
            n, low_bits, arrays[f"{name}.low"], arrays[f"{name}.high"] = EliasFano.encode(values)
            sizes[name] = (n, low_bits)
        head = json.dumps({"base": base, "levels": sizes, "parts": {k: (v.dtype.str, len(v)) for k, v in arrays.items()}}).encode()
        out = [len(head).to_bytes(8, "little"), head, b"\0" * (-len(head) % 8)]
        for v in arrays.values():
            out += [v.tobytes(), b"\0" * (-v.nbytes % 8)]
        return b"".join(out)

    def answer(self, words: np.ndarray, n_pairs: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and backoff codes of the words, probability codes of their successors (n_pairs of each word, in order)."""
        known = words >= np.uint64(self.base)
        at = np.where(known, self.words.find(np.where(known, words - np.uint64(self.base), np.uint64(0))), -1)
        counts = np.zeros(len(words), "<u4")
        backoff = np.full(len(words), NONE, "<u2")
        counts[at >= 0], backoff[at >= 0] = self.parts["counts"][at[at >= 0]], self.parts["backoff"][at[at >= 0]]
        probability = np.full(len(successor), NONE, "<u2")
        of = np.repeat(at, n_pairs)
        some = np.flatnonzero(of >= 0)
        place = self.successors.find((of[some].astype(np.uint64) << np.uint64(FP_BITS)) | successor[some])
        some, place = some[place >= 0], place[place >= 0]
        # A successor counts only between its context's pointers.
        inside = (place >= self.pointers.access(of[some]).astype(np.int64)) & (place < self.pointers.access(of[some] + 1).astype(np.int64))
        probability[some[inside]] = self.parts["probability"][place[inside]]
        return counts, backoff, probability


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEP), NONE - 1).astype("<u2")


def restored(code: np.ndarray, none: float) -> np.ndarray:
    table = np.append(10.0 ** (-np.arange(NONE) / STEP), none)
    return table[code]


def held_out(doc_id: int | None) -> bool:
    """Documents whose id, as text, has a CRC-32 that ten divides; those without an id are held out too."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def shard_of(words: np.ndarray, n_shards: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


class Block:
    """The tokens of some documents as places in the block's sorted distinct words."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.words, at = np.unique(np.append(flat, np.uint64(START)), return_inverse=True)
        self.at, self.start = at[:-1], int(at[-1])
        self.sizes = sizes

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, which): the distinct pairs of places, sorted, and each token's pair."""
        context, places = pairs_of(self.at, self.start, self.sizes), len(self.words)
        key, which = np.unique(context * places + self.at, return_inverse=True)
        return key // places, key % places, which


def pairs_of(at: np.ndarray, start: int, sizes: np.ndarray) -> np.ndarray:
    """The place of the word before each token; the start of a document has its own."""
    context = np.empty(len(at), np.int64)
    context[1:] = at[:-1]
    context[np.cumsum(sizes) - sizes] = start
    return context


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list, Block]]:
    """(number, document ids, block) of a task's rows; the same rows always make the same blocks."""
    hashes = WordHashes()
    docs: list = []
    parts: list[np.ndarray] = []
    size, number = 0, TaskContext.get().partitionId() << 24

    def made() -> Block:
        return Block(np.concatenate(parts), np.array([len(p) for p in parts], np.int64))

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            docs.append(doc)
            parts.append(np.append(hashes.of(raw.translate(LOWER).split()), np.uint64(END)))
            size += len(parts[-1])
            if size >= most:
                yield number, docs, made()
                docs, parts, size, number = [], [], 0, number + 1
    if docs:
        yield number, docs, made()


_ROUTED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_words", pa.int32()), ("n_pairs", pa.int32()), ("blob", pa.binary())])


def _pack(words: np.ndarray, counts: np.ndarray, per_word: np.ndarray, fp: np.ndarray, pair_counts: np.ndarray) -> bytes:
    return b"".join([words.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), per_word.astype("<u4").tobytes(), (fp >> np.uint64(8)).astype("<u4").tobytes(),
                     (fp & np.uint64(255)).astype(np.uint8).tobytes(), pair_counts.astype("<u4").tobytes()])


def _unpack(n: int, m: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    fp = (np.frombuffer(raw, "<u4", m, 16 * n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(raw, np.uint8, m, 16 * n + 4 * m)
    return (np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n), np.frombuffer(raw, "<u4", n, 12 * n), fp,
            np.frombuffer(raw[16 * n + 5 * m:], "<u4", m))


def _route(n_shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for number, docs, block in _blocks(batches, most):
                train = np.repeat(np.array([not held_out(d) for d in docs]), block.sizes)
                context, word, which = block.pairs()
                counts = np.bincount(block.at[train], minlength=len(block.words))
                pair_counts = np.bincount(which[train], minlength=len(context))
                del which
                per_word = np.bincount(context, minlength=len(block.words))
                fp = block.words[word] >> np.uint64(64 - FP_BITS)
                cut = np.searchsorted(shard_of(block.words, n_shards), np.arange(n_shards + 1))
                first = np.concatenate([[0], np.cumsum(per_word)])
                for s in np.flatnonzero(np.diff(cut)):
                    a, b = cut[s], cut[s + 1]
                    c, d = first[a], first[b]
                    yield {"shard": int(s), "block": number, "n_words": int(b - a), "n_pairs": int(d - c),
                           "blob": _pack(block.words[a:b], counts[a:b], per_word[a:b], fp[c:d], pair_counts[c:d])}

        yield from batches_of(_ROUTED, rows())

    return run


def _merged(parts: list[tuple]) -> bytes:
    """The trie of a shard from the training counts of all blocks."""
    words = np.unique(np.concatenate([p[0] for p in parts]))
    counts = np.zeros(len(words), np.int64)
    keys, n = [], []
    for own, c, per_word, fp, pair_counts in parts:
        at = np.searchsorted(words, own)
        counts[at] += c
        seen = pair_counts > 0
        keys.append(((np.repeat(at, per_word).astype(np.uint64) << np.uint64(FP_BITS)) | fp)[seen])
        n.append(pair_counts[seen])
    key, n_all = np.concatenate(keys), np.concatenate(n).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, n_all = key[order], n_all[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    totals = np.add.reduceat(n_all, first) if len(key) else n_all
    key = key[first]
    context = (key >> np.uint64(FP_BITS)).astype(np.int64)
    keep = counts > 0
    keep[context] = True
    place = np.cumsum(keep) - 1
    return Trie.build(words[keep], counts[keep], place[context], key & np.uint64((1 << FP_BITS) - 1), totals)


_ANSWERS = "shard bigint, block bigint, kind string, n_tokens bigint, n_known bigint, blob binary"


def _answers(shard: int, trie: Trie, pdf: pd.DataFrame, parts: list[tuple]) -> Iterator[tuple]:
    counts = trie.parts["counts"]
    yield shard, -1, "totals", int(counts.sum(dtype=np.int64)), int(np.count_nonzero(counts)), None
    for block, (words, _, per_word, fp, _) in zip(pdf["block"], parts, strict=True):
        yield shard, int(block), "answer", len(words), len(fp), b"".join(x.tobytes() for x in trie.answer(words, per_word, fp))


def _train(keep_tries: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(n, m, raw) for n, m, raw in zip(pdf["n_words"], pdf["n_pairs"], pdf["blob"], strict=True)]
        raw, shard = _merged(parts), int(pdf["shard"].iloc[0])
        rows = list(_answers(shard, Trie.mapped(raw), pdf, parts))
        if keep_tries:
            rows.append((shard, -1, "trie", 0, 0, raw))
        return pd.DataFrame(rows, columns=["shard", "block", "kind", "n_tokens", "n_known", "blob"])

    return run


def _ask(pdf: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
    parts = [_unpack(n, m, raw) for n, m, raw in zip(pdf["n_words"], pdf["n_pairs"], pdf["blob"], strict=True)]
    none = np.empty(0, np.uint64)
    raw = bytes(tries["blob"].iloc[0]) if len(tries) else Trie.build(none, none, none.astype(np.int64), none, none)
    shard = int((tries if len(tries) else pdf)["shard"].iloc[0])
    return pd.DataFrame(list(_answers(shard, Trie.mapped(raw), pdf, parts)), columns=["shard", "block", "kind", "n_tokens", "n_known", "blob"])


_FRAMES = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])


def _frame(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for number, docs, block in _blocks(batches, most):
                at = block.at.astype("<u4").view(np.uint8).reshape(-1, 4)
                width = 4 if len(block.words) >> 24 else 3
                yield {"block": number, "n_words": len(block.words), "start": block.start, "docs": docs, "sizes": block.sizes.tolist(),
                       "blob": np.ascontiguousarray(at[:, :width]).tobytes()}

        yield from batches_of(_FRAMES, rows())

    return run


def _read(n_train: int, n_vocabulary: int):
    floor = math.log10(n_train + 0.1 * (n_vocabulary + 1))

    def run(frames: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("shard")
        n, m = answers["n_tokens"].to_numpy(), answers["n_known"].to_numpy()
        raws = answers["blob"].tolist()
        counts = np.concatenate([np.frombuffer(r, "<u4", a) for r, a in zip(raws, n, strict=True)])
        backoff = np.concatenate([np.frombuffer(r, "<u2", a, 4 * a) for r, a in zip(raws, n, strict=True)])
        seen = np.concatenate([np.frombuffer(r[6 * a:], "<u2", b) for r, a, b in zip(raws, n, m, strict=True)])
        frame = frames.iloc[0]
        sizes = np.asarray(frame["sizes"], np.int64)
        tokens = int(sizes.sum())
        width = len(frame["blob"]) // tokens
        at = np.zeros((tokens, 4), np.uint8)
        at[:, :width] = np.frombuffer(frame["blob"], np.uint8).reshape(tokens, width)
        at = at.view("<u4")[:, 0].astype(np.int64)
        context = pairs_of(at, int(frame["start"]), sizes)
        key, which = np.unique(context * int(frame["n_words"]) + at, return_inverse=True)
        if len(key) != len(seen) or len(counts) != frame["n_words"]:
            raise ValueError("the answers do not fit the block")
        alone = np.log10(counts + 0.1) - floor
        # A context that was never seen leaves all mass to the words by themselves.
        mass = restored(backoff, 1.0)
        score = np.log10(restored(seen, 0.0)[which] + mass[context] * 10.0 ** alone[at])
        first = np.cumsum(sizes) - sizes
        docs = [None if d is None or d != d else int(d) for d in frame["docs"]]
        return pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "held_out": [held_out(d) for d in docs], "n_tokens": sizes,
                             "n_known": np.add.reduceat((counts > 0)[at].astype(np.int64), first), "train_tokens": n_train,
                             "base_score": np.add.reduceat(alone[at], first), "score": np.add.reduceat(score, first)})

    return run


def _shards(docs: DataFrame, text: str) -> int:
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-chars // SHARD_CHARS))


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None, save: str | None = None, block: int = BLOCK) -> DataFrame:
    """Log10 probabilities of all rows under a smoothed word-pair model of the rows that are not held out.

    A word's probability after its context is the discounted relative frequency of the pair plus the discounted mass times the word's
    own probability, (c + 0.1) / (N + 0.1 (V + 1)); base_score takes the latter alone. Probabilities of pairs and masses are stored in
    steps of 1/4096 of log10. `save` names a folder for the tries, `model` one to score by instead of training. Null and empty texts
    are the end token alone, rows without an id are held out, repeated rows each count and get a row, whole texts of any length are
    read, and an empty table gives an empty result. Only the two columns named are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tries = None if model is None else spark.read.parquet(model).where("kind = 'trie'")
    n_shards = _shards(docs, text) if tries is None else tries.agg(F.max("n_tokens")).first()[0] or 1
    routed = rows.mapInArrow(_route(n_shards, block), "shard bigint, block bigint, n_words int, n_pairs int, blob binary")
    if tries is None:
        answers = stage(routed.groupBy("shard").applyInPandas(_train(save is not None), _ANSWERS))
        totals = answers.where("kind = 'totals'")
        if save is not None:
            held = answers.where("kind = 'trie'").withColumn("n_tokens", F.lit(n_shards).cast("bigint"))
            held.unionByName(totals).write.parquet(save)
    else:
        answers = stage(routed.groupBy("shard").cogroup(tries.groupBy("shard")).applyInPandas(_ask, _ANSWERS))
        totals = spark.read.parquet(model).where("kind = 'totals'")
    n_train, n_vocabulary = totals.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    frames = rows.mapInArrow(_frame(block), "block bigint, n_words bigint, start bigint, docs array<bigint>, sizes array<bigint>, blob binary")
    asked = answers.where("kind = 'answer'").select("shard", "block", "n_tokens", "n_known", "blob")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return frames.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(_read(int(n_train), int(n_vocabulary)), schema)
