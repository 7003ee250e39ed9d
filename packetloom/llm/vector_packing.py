"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept_by_worker, stage

#: Chunks whose ids a worker remembers, in two halves of which the older one is dropped when both are full; bounds its memory.
CACHED_CHUNKS = 2_000_000
#: Characters that are encoded together.
SLICE_CHARS = 2_000_000
#: Items that are packed together, on average.
GROUP = 8_192


class Limits(NamedTuple):
    """What a sequence may hold at most: tokens, pieces, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class ChunkIds:
    """Token ids of texts by a byte-level vocabulary, from the remembered ids of their chunks (white space and what follows it).

    The pre-tokenizer always ends a piece where white space follows something else, so chunks can be encoded one by one. Four
    control characters are white space here and not there; texts that have them are encoded whole.
    """

    CHUNK = re.compile(r"\s*\S+|\s+")
    UNSURE = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each id: the vocabulary spells a byte as a character, added tokens are spelled as they are.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks that begin with white space and end without are encoded as one text, whose ids are cut at their ends."""
        joined = [x for x in chunks if x[0].isspace() and not x[-1].isspace()]
        out = {}
        for lo in range(0, len(joined), 20_000):
            part = joined[lo:lo + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends, wanted = np.cumsum(self.width[ids]), np.cumsum([len(x.encode()) for x in part])
            at = np.searchsorted(ends, wanted)
            if at[-1] >= len(ends) or not np.array_equal(ends[at], wanted):
                raise ValueError("the tokenizer joins ids across white space")
            raw, cut = ids.tobytes(), ((at + 1) * self.dtype.itemsize).tolist()
            out.update(zip(part, [raw[i:j] for i, j in zip([0, *cut[:-1]], cut, strict=True)], strict=True))
        rest = [x for x in chunks if x not in out]
        for lo in range(0, len(rest), 20_000):
            part = rest[lo:lo + 20_000]
            out.update(zip(part, self._encode(part), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian integers of the width of `dtype`."""
        whole = [any(c in x for c in self.UNSURE) for x in texts]
        chunks = [[] if w else self.CHUNK.findall(x) for x, w in zip(texts, whole, strict=True)]
        # Texts share most of their chunks, so each different one is looked up once and the texts are read from a small table.
        distinct = set().union(*chunks)
        ids = {x: self.known[x] for x in distinct & self.known.keys()}
        new = distinct.difference(ids)
        held = {x: self.earlier[x] for x in new & self.earlier.keys()}
        held.update(self._encode_chunks([x for x in new if x not in held]))
        ids.update(held)
        out = [self._encode([x])[0] if w else b"".join(map(ids.__getitem__, c)) for x, w, c in zip(texts, whole, chunks, strict=True)]
        # Of the chunks of the half that is full, those seen again move on to the next one.
        if len(self.known) + len(held) > CACHED_CHUNKS // 2:
            self.earlier, self.known = self.known, {}
        self.known.update((x, y) for x, y in held.items() if len(x) <= 64)
        return out


_ITEMS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("silent", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _items(tokenizer: str, limits: Limits, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(("chunk ids", tokenizer), lambda: ChunkIds(tokenizer))
        room = limits.tokens

        def rows(docs: list, prompts: list[str], texts: list[str]) -> pa.RecordBatch:
            out: dict[str, list] = {f.name: [] for f in _ITEMS}
            both = encoder.encode(prompts + texts)
            for doc, first, rest in zip(docs, both[:len(docs)], both[len(docs):], strict=True):
                prompt = len(first) // encoder.dtype.itemsize
                ids = np.append(np.frombuffer(first + rest, encoder.dtype), encoder.dtype.type(end))
                for lo in range(0, len(ids), room):
                    part = ids[lo:lo + room]
                    silent = min(max(prompt - lo, 0), len(part))
                    alone = len(part) == room and len(part) - silent <= limits.loss
                    crc = zlib.crc32(part.astype("<u4").tobytes()) if alone else None
                    held = part.tobytes() if with_ids or not alone else None
                    for name, value in zip(out, (doc, lo, len(part), silent, crc, len(ids), held), strict=True):
                        out[name].append(value)
            return pa.RecordBatch.from_pydict(out, schema=_ITEMS)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            prompts, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (1, 2))
            lo = size = 0
            for hi in range(len(docs)):
                size += len(prompts[hi]) + len(texts[hi])
                if size >= SLICE_CHARS:
                    yield rows(docs[lo:hi + 1], prompts[lo:hi + 1], texts[lo:hi + 1])
                    lo, size = hi + 1, 0
            if lo < len(docs):
                yield rows(docs[lo:], prompts[lo:], texts[lo:])

    return run


class Pool:
    """Unplaced items (item, start, length, silent leading tokens), kept by their demand on (tokens, segments, loss)."""

    def __init__(self, items: list[tuple[int, int, int, int]], limits: Limits):
        self.limits = np.array(limits, np.int64)
        self.left = np.zeros(3, np.int64)
        self.row: dict[tuple[int, int], int] = {}
        self.stacks: list[list] = []
        self.cubed = self.limits.astype(float) ** 3
        self.size = np.zeros((64, 3), np.int64, order="F")
        self.held = np.zeros(64, np.int64)
        for item in items:
            self.add(item)

    def add(self, item: tuple[int, int, int, int]) -> None:
        demand = item[2], item[2] - item[3]
        row = self.row.setdefault(demand, len(self.stacks))
        if row == len(self.stacks):
            self.stacks.append([])
            if row == len(self.held):
                self.size = np.asfortranarray(np.concatenate([self.size, np.zeros_like(self.size)]))
                self.held = np.concatenate([self.held, np.zeros_like(self.held)])
            self.size[row] = demand[0], 1, demand[1]
        self.stacks[row].append(item)
        self.held[row] += 1
        self.left += self.size[row]

    def take(self, row: int) -> tuple[int, int, int, int]:
        self.held[row] -= 1
        self.left -= self.size[row]
        return self.stacks[row].pop()

    def best(self, free: np.ndarray, whole: bool) -> int | None:
        """The kind with the largest dot product of its demand and the free room, each dimension in shares of its limit and weighted
        by what all unplaced items still demand of it. Only kinds that fit whole, or any of which a first token fits."""
        if free[1] < 1:
            return None
        n = len(self.stacks)
        tokens, loss = self.size[:n, 0], self.size[:n, 2]
        open_to = self.held[:n] > 0
        if whole:
            open_to &= tokens <= free[0]
            open_to &= loss <= free[2]
        rows = np.flatnonzero(open_to)
        if not len(rows):
            return None
        scale = free * self.left / self.cubed
        return int(rows[np.argmax(tokens[rows] * scale[0] + scale[1] + loss[rows] * scale[2])])


def fill(items: list[tuple[int, int, int, int]], limits: Limits, cut: bool = True) -> list[list[tuple[int, int, int, int]]]:
    """Sequences of pieces (item, start, length, silent). With `cut` a gap is filled with the front of a further item, and a sequence
    that has to end before it is full ends at a power of two and gives the rest back, so that no sequence needs padding."""
    pool, out = Pool(items, limits), []
    while pool.left[0]:
        free = pool.limits.copy()
        held: list[tuple[int, int, int, int]] = []
        while free[0]:
            row = pool.best(free, True)
            if row is not None:
                piece = pool.take(row)
            elif not cut or (row := pool.best(free, False)) is None:
                break
            else:
                item, start, length, silent = pool.take(row)
                n = int(min(free[0], silent + free[2], length))
                if n:
                    pool.add((item, start + n, length - n, max(silent - n, 0)))
                    piece = (item, start, n, min(silent, n))
                else:
                    pool.add((item, start, length, silent))
                    break
            held.append(piece)
            free -= (piece[2], 1, piece[2] - piece[3])
        over = int(limits.tokens - free[0])
        over -= 1 << (over.bit_length() - 1)
        while cut and free[0] and over:
            item, start, length, silent = held.pop()
            back = min(over, length)
            if back < length:
                held.append((item, start, length - back, min(silent, length - back)))
            pool.add((item, start + length - back, back, max(silent - (length - back), 0)))
            over -= back
        out.append(held)
    return out


_PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint, ids binary"


def _pack(limits: Limits, cut: bool, with_ids: bool, dtype: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids"], ascending=[False, True, True, True], ignore_index=True)
        items = list(zip(range(len(pdf)), [0] * len(pdf), pdf["length"].tolist(), pdf["silent"].tolist(), strict=True))
        base = int(pdf["group"].iloc[0]) << 32
        ids = [np.frombuffer(x, dtype) for x in pdf["ids"]]
        docs, starts, totals = pdf["doc_id"], pdf["start"].tolist(), pdf["doc_tokens"].tolist()
        rows = []
        for k, held in enumerate(fill(items, limits, cut)):
            at = 0
            for item, start, length, silent in held:
                part = ids[item][start:start + length]
                rows.append((item, starts[item] + start, length, zlib.crc32(part.astype("<u4").tobytes()), totals[item], base + k, at, length - silent,
                             part.tobytes() if with_ids else None))
                at += length
        out = pd.DataFrame(rows, columns=["item", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"])
        out.insert(0, "doc_id", docs.take(out.pop("item")).array)
        return out

    return run


def pack_examples(examples: DataFrame, tokenizer: str, limits: Limits = Limits(), *, end: int = 1, cut: bool = True, with_ids: bool = False,
                  text: str = "text", prompt: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Examples packed into sequences within all three limits: a row per piece with its place, its loss-bearing tokens and, if
    wanted, its ids as little-endian integers.

    An example is the ids of its prompt, which bear no loss, those of its text, and the end id. Stretches of limits.tokens that keep
    the limits are sequences by themselves. All other stretches are dealt out by hash into groups of about GROUP items, and each
    group is packed bin by bin: the free room of the bin picks the item with the largest dot product. Pieces of one example may
    lie in different sequences; without `cut` only examples of more than limits.tokens are cut.

    Null and empty texts are the end id alone. Repeated rows, null ids and ties are packed like any others; only the named columns
    are read, so others may have any name. An empty table gives an empty result.
    """
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    if not cut and limits.loss < limits.tokens:
        raise ValueError("without cuts a stretch of limits.tokens must keep the limit on loss")
    given = F.col(prompt) if prompt else F.lit("")
    rows = examples.select(F.col(doc_id).cast("bigint").alias("doc_id"), given.alias("prompt"), F.col(text).alias("text"))
    kinds = {pa.int64(): "bigint", pa.binary(): "binary"}
    items = stage(rows.mapInArrow(_items(tokenizer, limits, end, with_ids), ", ".join(f"{f.name} {kinds[f.type]}" for f in _ITEMS)))
    alone = items.where("ids_crc32 is not null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), (F.col("length") - F.col("silent")).alias("loss_tokens"), "ids")
    rest = items.where("ids_crc32 is null")
    n_groups = max(1, -(-rest.count() // GROUP))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(n_groups)))
    dtype = ChunkIds(tokenizer).dtype.str
    packed = dealt.groupBy("group").applyInPandas(_pack(limits, cut, with_ids, dtype), _PLACED)
    out = alone.unionByName(packed)
    return out if with_ids else out.drop("ids")
