"""Chat formatting at token level: segments are encoded separately, reserved ids spliced in, and masks come from prefix sums."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import batches_of

#: The template: <|turn|>role<|text|>text<|end|> for every turn. Each mark is one reserved id over the vocabulary's 50,256.
TURN, TEXT, END = 50256, 50257, 50258
MARKS = {TURN: "<|turn|>", TEXT: "<|text|>", END: "<|end|>"}
#: Control strings of this and other templates. One that occurs in a text gets a backslash after its first character, and one that
#: has backslashes there gets one more, so taking one away restores the text.
_CONTROL = r"(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|[A-Za-z_]+\|>)"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
#: Code points that are encoded at a time; any cut decodes to the same text.
SLICE = 4096
#: Turns per slice of a conversation, whose lengths are summed by themselves.
SLICE_TURNS = 1024


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class Codec:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return [i for lo in range(0, len(text), SLICE) for i in self.encoding.encode_ordinary(text[lo:lo + SLICE])]

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes([int(i) for i in ids]).decode()


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("ids", pa.binary()), ("n_tokens", pa.int64()),
                       ("text_from", pa.int64()), ("loss", pa.bool_())])


def _encode(path: str, pattern: str, loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    head = [TURN, *codec.encode(escape(role or "")), TEXT]
                    ids = np.array([*head, *codec.encode(escape(text or "")), END], "<u4")
                    yield {"conv_id": conv, "turn": turn, "role": role, "ids": ids.tobytes(), "n_tokens": len(ids), "text_from": len(head), "loss": role == loss_role}

        yield from batches_of(_SEGMENTS, rows())

    return run


def segments(turns: DataFrame, vocabulary: str, pattern: str, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, turn, role, token `ids` (bytes, 32 bits each), and its place `start` in the conversation.

    The conversation's ids are those of its rows one after another. `loss_from` and `loss_to` bound the tokens under the loss mask,
    null for turns without loss. Places are prefix sums of the segments' lengths: inside slices of SLICE_TURNS turns, and over the
    slices, so a conversation of any length is never gathered. Null texts and roles are empty; rows of one turn follow by role and
    ids, repeated rows are repeated turns; rows without conv_id form one conversation and those without turn come first. Only the
    four columns conv_id, turn, role and text are read. An empty table gives an empty one.
    """
    given = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    schema = "conv_id bigint, turn bigint, role string, ids binary, n_tokens bigint, text_from bigint, loss boolean"
    encoded = given.mapInArrow(_encode(vocabulary, pattern, loss_role), schema).withColumn("slice", F.floor(F.col("turn") / SLICE_TURNS))
    before = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = encoded.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    sums = encoded.groupBy("conv_id", "slice").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    out = placed.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("slice").eqNullSafe(F.col("s")))
    start = F.col("ahead") + F.col("inside")
    return out.select("conv_id", "turn", "role", "ids", start.alias("start"), F.when(F.col("loss"), start + F.col("text_from")).alias("loss_from"),
                      F.when(F.col("loss"), start + F.col("n_tokens") - 1).alias("loss_to"))


def mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """The loss mask of n tokens: a prefix sum over +1 where a span begins and -1 where it ends."""
    edges = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    return np.cumsum(edges[:-1]) > 0


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                   ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])


def _read_back(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)

        def rows() -> Iterator[dict]:
            now, out, turns, loss = object(), None, None, None
            for batch in batches:
                for conv, raw, start, loss_from, loss_to in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "ids", "start", "loss_from", "loss_to")), strict=True):
                    if out is None or conv != now:
                        if out:
                            yield out | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
                        now, turns, loss = conv, hashlib.sha256(), hashlib.sha256()
                        out = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_tokens": 0, "n_loss_tokens": 0}
                    ids = np.frombuffer(raw, "<u4")
                    if start != out["n_tokens"] or ids[0] != TURN or ids[-1] != END:
                        raise ValueError(f"conversation {conv}: a segment does not begin where the one before it ends")
                    cut = int(np.flatnonzero(ids == TEXT)[0])
                    role, text = codec.decode(ids[1:cut]), codec.decode(ids[cut + 1:-1])
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    held = mask(len(ids), [] if loss_from is None else [(loss_from - start, loss_to - start)])
                    if loss_from is not None:
                        under = unescape(codec.decode(ids[held]))
                        loss.update(under.encode())
                        out["loss_chars"] += len(under)
                    out["n_turns"] += 1
                    out["n_tokens"] += len(ids)
                    out["n_loss_tokens"] += int(held.sum())
                    out["formatted_chars"] += len(role) + len(text) + sum(map(len, MARKS.values()))
            if out:
                yield out | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        yield from batches_of(_READ, rows())

    return run


def read_back(formatted: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Digests of every conversation, decoded from its ids and mask. Conversations are streamed, so their length does not matter."""
    rows = formatted.select("conv_id", "ids", "start", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, "
              "n_loss_tokens bigint")
    return rows.mapInArrow(_read_back(vocabulary, pattern), schema)
