"""Best-fit packing of token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept_by_worker, lean, stage

ROOM = 2048
#: Words whose ids a worker remembers before it starts anew; bounds its memory.
CACHED_IDS = 1_200_000
#: Pieces that are packed together, on average.
GROUP = 16_384


class WordTokens:
    """Token ids of texts from the ids of their words, which are remembered. Words end at spaces and line feeds.

    The vocabulary drops white space and never joins across it, so the ids of a text are those of its words one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        split = [x.replace("\n", " ").split(" ") for x in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > CACHED_IDS:
            self.known = {}
            new = set().union(*split)
        if new:
            words = list(new)
            for lo in range(0, len(words), 20_000):
                part = words[lo:lo + 20_000]
                found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part)), side="right").tolist()
                raw, at = ids.tobytes(), 0
                for word, end in zip(part, ends, strict=True):
                    self.known[word] = raw[4 * at:4 * end]
                    at = end
        out = [b"".join(map(self.known.__getitem__, x)) for x in split]
        if any(len(w) > 256 for w in new):
            self.known = {w: i for w, i in self.known.items() if len(w) <= 256}
        return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _cut(path: str, room: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker(("word tokens", path), lambda: WordTokens(path))

        def rows(docs: list, texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            for doc, raw in zip(docs, tokens.encode(texts), strict=True):
                raw += b"\0\0\0\0"
                for k, lo in enumerate(range(0, len(raw), 4 * room)):
                    ids = raw[lo:lo + 4 * room]
                    for name, value in zip(out, (doc, k, lo // 4, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None), strict=True):
                        out[name].append(value)
            return out

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            lo, size = 0, 0
            for hi in range(len(docs) + 1):
                if hi == len(docs) or size and size + len(texts[hi]) > 4_000_000:
                    if hi > lo:
                        yield pa.RecordBatch.from_pydict(rows(docs[lo:hi], texts[lo:hi]), schema=_PIECES)
                    lo, size = hi, 0
                if hi < len(docs):
                    size += len(texts[hi])

    return run


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents' tokens, an end token 0 after each, cut where a document has more than `room`; ids as bytes if wanted."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_cut(tokenizer, room, with_ids), keeps=True), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Items by decreasing length, each into the fullest bin that has room for it. A bit per free space finds that bin."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space, b = room, len(bins)
            bins.append([])
        bins[b].append(item)
        left = space - n
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    """Empties the least filled bins by moves and by one-for-one and two-for-one exchanges with other underfull bins.

    Every step puts more into a bin that is at least as full as the donor, so the sum of squared fills grows and the search ends.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = sorted((b for b in range(len(bins)) if fill[b] < room), key=lambda b: (fill[b], b))
    items = [i for b in under for i in bins[b]]
    if len(under) < 2:
        return [b for b in bins if b]
    slot = {i: k for k, i in enumerate(items)}
    size = np.array([lengths[i] for i in items], np.int64)
    home = np.array([b for b in under for _ in bins[b]], np.int64)
    space = np.full(len(bins), -1, np.int64)
    filled = np.array(fill, np.int64)
    space[under] = room - filled[under]

    def put(i: int, b: int) -> None:
        old = int(home[slot[i]])
        bins[old].remove(i)
        bins[b].append(i)
        home[slot[i]] = b
        for x, n in ((old, -lengths[i]), (b, lengths[i])):
            filled[x] += n
            space[x] -= n

    for donor in under:
        going = True
        while going and bins[donor]:
            going = False
            own = sorted(bins[donor], key=lambda i: -lengths[i])
            other = (home != donor) & (filled[home] >= filled[donor]) & (filled[home] > 0)
            for k, a in enumerate(own):
                open_to = np.where((space >= lengths[a]) & (filled >= filled[donor]) & (filled > 0))[0]
                open_to = open_to[open_to != donor]
                if len(open_to):
                    put(a, int(open_to[np.argmin(space[open_to])]))
                    going = True
                    break
                offers = [((a,), lengths[a])] + [((a, b), lengths[a] + lengths[b]) for b in own[k + 1:k + 9]]
                best = None
                for given, n in offers:
                    gain = n - size
                    good = other & (gain > 0) & (gain <= space[home])
                    if good.any():
                        at = int(np.argmax(np.where(good, gain, 0)))
                        if best is None or gain[at] > best[0]:
                            best = (int(gain[at]), given, items[at], int(home[at]))
                if best:
                    _, given, back, target = best
                    put(back, donor)
                    for i in given:
                        put(i, target)
                    going = True
                    break
        if bins[donor]:
            space[donor] = room - filled[donor]
        else:
            space[donor] = -1
    return [b for b in bins if b]


def _pack(room: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        number, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, held in enumerate(local_search(best_fit(lengths, room), lengths, room)):
            at = 0
            for i in held:
                number[i], offset[i] = k, at
                at += lengths[i]
        return pdf.assign(sequence_id=pdf["group"].astype("int64") * (1 << 32) + number, offset=offset).drop(columns="group")

    return run


def pack(cut: DataFrame, room: int = ROOM) -> DataFrame:
    """The pieces with sequence_id and offset. Full pieces are sequences by themselves.

    The others are dealt out by hash into groups of about GROUP pieces, each packed by best fit and then by swaps. A group leaves
    about one bin underfull, so many groups cost next to nothing. Repeated rows and ties are packed like any others.
    """
    cut = stage(cut)
    n_groups = max(1, -(-cut.count() // GROUP))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("group").applyInPandas(_pack(room), schema)


def pack_documents(docs: DataFrame, tokenizer: str, room: int = ROOM, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents packed into sequences of at most `room` tokens: a row per piece with its place.

    Null and empty texts are the end token alone. Long documents are cut into pieces of `room` tokens. Only the two columns named
    are read. An empty table gives an empty result.
    """
    out = pack(pieces(docs, tokenizer, room, with_ids, text, doc_id), room)
    return out if with_ids else out.drop("ids")
