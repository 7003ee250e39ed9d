"""How far the sources of a language differ in their words: vocabularies as minimal transducers, exact integer divergences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import batches_of, partitions, stage

#: ASCII letters in lower case and all bytes beyond ASCII; everything else ends a term.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Keys of one transducer, and different terms a task counts before it passes them on. Both bound memory.
BLOCK_KEYS = 50_000
HELD_TERMS = 400_000
#: Terms of one row on the way to a transducer.
STREAM_TERMS = 4_096
#: Bytes of terms that go through a transducer side by side.
STREAM_BYTES = 1 << 19
SCALE = 1_000_000_000
#: Rows whose pairs of sources are added up together, beyond the last term.
PAIR_ROWS = 100_000


class Transducer:
    """Minimal acyclic automaton of sorted keys whose arcs add up to the ordinal of a key.

    Arcs are sorted by (state, byte). An arc's output is the number of keys that come before those beyond it.
    """

    def __init__(self, arcs: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray):
        self.arcs, self.targets, self.outputs, self.final = arcs, targets, outputs, final
        self.start = len(final) - 1

    @classmethod
    def of(cls, keys: list[bytes]) -> Transducer:
        """From keys in byte order, each once. States that no later key can reach are looked up by what they accept."""
        known: dict[tuple, int] = {}
        arcs: list[int] = []
        targets: list[int] = []
        outputs: list[int] = []
        final: list[bool] = []
        reach: list[int] = []
        #: The states along the last key: whether it ends there, and its arcs, the last one still open.
        path: list[list] = [[False, []]]
        letters: list[int] = []

        def close(state: list) -> int:
            name = state[0], tuple(state[1])
            number = known.get(name)
            if number is None:
                number = known[name] = len(final)
                before = int(state[0])
                for byte, target in state[1]:
                    arcs.append(number << 8 | byte)
                    targets.append(target)
                    outputs.append(before)
                    before += reach[target]
                final.append(state[0])
                reach.append(before)
            return number

        def shorten(depth: int) -> None:
            while len(letters) > depth:
                number = close(path.pop())
                path[-1][1].append((letters.pop(), number))

        for key in keys:
            depth = 0
            for a, b in zip(letters, key, strict=False):
                if a != b:
                    break
                depth += 1
            shorten(depth)
            for byte in key[depth:]:
                letters.append(byte)
                path.append([False, []])
            path[-1][0] = True
        shorten(0)
        # The start accepts all keys, so it equals no other state and gets the last number.
        close(path[0])
        return cls(np.array(arcs, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array(final, bool))

    def dump(self) -> bytes:
        head = np.array([len(self.arcs), len(self.final)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.arcs, self.targets, self.outputs, self.final))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        n, _ = np.frombuffer(data, np.int64, 2).tolist()
        parts = [np.frombuffer(data, np.int64, n, 16 + 8 * n * i) for i in range(3)]
        return cls(*parts, np.frombuffer(data, bool, offset=16 + 24 * n))

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the arcs, and where there are any."""
        wanted = state << 8 | byte
        at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
        return at, self.arcs[at] == wanted

    def ordinals(self, prefix: bytes, text: bytes) -> np.ndarray:
        """The ordinal of prefix + term for every term of a text (each ended by a space), -1 where it is no key. All terms go through
        the automaton side by side, a byte each at a time."""
        stream = np.frombuffer(text, np.uint8).astype(np.int64)
        ends = np.flatnonzero(stream == 32)
        out = np.full(len(ends), -1, np.int64)
        if not len(ends) or not len(self.arcs):
            return out
        state, total = self.start, 0
        for byte in prefix:
            at, found = self._step(np.array([state]), np.array([byte]))
            if not found[0]:
                return out
            state, total = int(self.targets[at[0]]), total + int(self.outputs[at[0]])
        here = np.append(0, ends[:-1] + 1)
        which, states, sums = np.arange(len(ends)), np.full(len(ends), state), np.full(len(ends), total)
        while len(which):
            done = here == ends[which]
            accepted = done & self.final[states]
            out[which[accepted]] = sums[accepted]
            which, states, sums, here = (x[~done] for x in (which, states, sums, here))
            if len(which):
                at, found = self._step(states, stream[here])
                which, at = which[found], at[found]
                states, sums, here = self.targets[at], sums[found] + self.outputs[at], here[found] + 1
        return out

    def keys(self) -> Iterator[bytes]:
        """All keys in order."""
        stack = [(self.start, b"")]
        first = np.searchsorted(self.arcs, np.arange(len(self.final) + 1) << 8).tolist()
        arcs, targets, final = self.arcs.tolist(), self.targets.tolist(), self.final.tolist()
        while stack:
            state, spelled = stack.pop()
            if final[state]:
                yield spelled
            for i in range(first[state + 1] - 1, first[state] - 1, -1):
                stack.append((targets[i], spelled + bytes([arcs[i] & 255])))


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


_COUNTED = pa.schema([("key", pa.binary()), ("n", pa.int64())])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each key occurs, where a key is a language, a zero byte and a term."""
    counts: dict[bytes, Counter[bytes]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, held in counts.items():
            yield pa.RecordBatch.from_pydict({"key": [lang + b"\0" + t for t in held], "n": list(held.values())}, schema=_COUNTED)
        counts.clear()

    held = 0
    for batch in batches:
        for lang, text in zip(*(c.cast(pa.large_binary()).to_pylist() for c in batch.columns), strict=True):
            known = counts.setdefault(lang, Counter())
            held -= len(known)
            known.update(set(text.translate(TERMS).split()))
            held += len(known)
            if held > HELD_TERMS:
                yield from flush()
                held = 0
    yield from flush()


_BLOCK = pa.schema([("first", pa.binary()), ("n", pa.int64()), ("machine", pa.binary())])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block(keys: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"first": keys[0], "n": len(keys), "machine": Transducer.of(keys).dump()}], _BLOCK)

    held: list[bytes] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= BLOCK_KEYS:
            yield block(held[:BLOCK_KEYS])
            held = held[BLOCK_KEYS:]
    if held:
        yield block(held)


def vocabulary(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """The kept terms as transducers (first key, base, n, machine) of at most BLOCK_KEYS neighbouring keys; base plus the ordinal
    inside the block is the place of a key in the order of all languages and terms."""
    spark = docs.sparkSession
    kept = _rows(docs, "lang", "text").mapInArrow(_document_counts, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    # The sort reads the kept keys twice, once to find its ranges.
    ordered = stage(kept.select("key")).repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    blocks = stage(ordered.mapInArrow(_build, "first binary, n bigint, machine binary"))
    before = blocks.select("first", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return stage(blocks.join(before, "first"))


def _split(key: bytes) -> tuple[bytes, bytes]:
    lang, _, term = key.rpartition(b"\0")
    return lang, term


def terms(blocks: DataFrame) -> DataFrame:
    """(ord, lang, term) of every key that the transducers accept."""
    schema = pa.schema([("ord", pa.int64()), ("lang", pa.string()), ("term", pa.string())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, machine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = [_split(k) for k in Transducer.load(machine).keys()]
                columns = [range(base, base + len(pairs)), [lang.decode() for lang, _ in pairs], [term.decode() for _, term in pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.select("base", "machine").mapInArrow(spell, "ord bigint, lang string, term string")


_STREAM = pa.schema([("block", pa.int64()), ("salt", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("terms", pa.binary()), ("counts", pa.binary())])


def _streams(firsts: list[bytes], salts: int):
    """Counts the terms of a task's texts by language and source and sends them, sorted, to the blocks where they would be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        counts: dict[tuple[bytes, bytes], Counter[bytes]] = {}

        def rows() -> Iterator[dict]:
            for (lang, source), held in counts.items():
                prefix, ordered = lang + b"\0", sorted(held)
                lo = 0
                while lo < len(ordered):
                    block = bisect_right(firsts, prefix + ordered[lo]) - 1
                    hi = min(lo + STREAM_TERMS, len(ordered))
                    if block + 1 < len(firsts) and firsts[block + 1].startswith(prefix):
                        hi = bisect_left(ordered, firsts[block + 1][len(prefix):], lo, hi)
                    part = ordered[lo:hi]
                    if block >= 0:
                        yield {"block": block, "salt": salt, "lang": lang.decode(), "source": source.decode(), "terms": b" ".join(part) + b" ",
                               "counts": np.fromiter(map(held.__getitem__, part), np.int64, len(part)).tobytes()}
                    lo = hi
            counts.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.cast(pa.large_binary()).to_pylist() for c in batch.columns), strict=True):
                known = counts.setdefault((lang, source), Counter())
                # A group counts as some terms itself, so that many small groups are bounded too.
                size += 0 if known else 16
                size -= len(known)
                known.update(text.translate(TERMS).split())
                size += len(known)
                if size > HELD_TERMS:
                    yield from batches_of(_STREAM, rows())
                    size = 0
        yield from batches_of(_STREAM, rows())

    return run


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ord", pa.int64()), ("n", pa.int64())])


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, salt and language: first a block's transducer, then the terms to stream through it. The rows of a language
    go through it together, about STREAM_BYTES at a time."""
    machine, base, held, size = None, 0, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        places = machine.ordinals(held[0]["lang"].encode() + b"\0", b"".join(r["terms"] for r in held))
        known = np.flatnonzero(places >= 0)
        if len(known):
            owner = pa.array(np.repeat(np.arange(len(held)), [len(r["counts"]) // 8 for r in held])[known])
            names = [pa.array([r[c] for r in held], pa.string()).take(owner) for c in ("lang", "source")]
            counts = np.frombuffer(b"".join(r["counts"] for r in held), np.int64)
            yield pa.RecordBatch.from_arrays([*names, pa.array(places[known] + base), pa.array(counts[known])], schema=_FOUND)
        held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["machine"] is not None or row["lang"] != held[0]["lang"] or size > STREAM_BYTES):
                yield from flush()
                size = 0
            if row["machine"] is not None:
                machine, base = Transducer.load(row["machine"]), row["base"]
                continue
            held.append(row)
            size += len(row["terms"])
    yield from flush()


def recount(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, source, ord, n): how often each kept term occurs in each group, by streaming the texts' terms through the transducers.

    The driver sees one key per block, that is one for BLOCK_KEYS kept terms. The terms meet their transducer in as many tasks as there
    are partitions, each with the transducers of its blocks and salts one after another.
    """
    spark = docs.sparkSession
    listed = [(bytes(r["first"]), r["base"]) for r in blocks.select("first", "base").orderBy("first").toLocalIterator()]
    bases = [b for _, b in listed]
    salts = max(1, partitions(spark) // max(1, len(listed)))
    streams = _rows(docs, "lang", "source", "text").mapInArrow(
        _streams([f for f, _ in listed], salts), "block bigint, salt int, lang string, source string, terms binary, counts binary")
    number = spark.createDataFrame(list(enumerate(bases)), "block bigint, base bigint")
    machines = blocks.select("base", "machine").join(number, "base").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = streams.unionByName(machines, allowMissingColumns=True)
    dealt = both.repartition(partitions(spark), "block", "salt").sortWithinPartitions("block", "salt", F.col("machine").isNull(), "lang")
    found = dealt.select("base", "machine", "lang", "source", "terms", "counts").mapInArrow(_recount, "lang string, source string, ord bigint, n bigint")
    return found.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def probability(n: Column, total: Column, terms_kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact; null where no term is kept."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    below = F.nullif(total + terms_kept, F.lit(0)).cast("decimal(19,0)")
    return _floor_divide(above, below) + 1


def _floor_divide(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _floor_divide((p - q) * (p - q), q)


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term: for each two sources that share a term, what the sum over all terms has to be corrected by. Row i meets row
    i + d of the same term for d = 1, 2, ..., so all terms of a chunk are dealt with at once; sums are passed on by chunk."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def sums(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        langs, lang_names = pd.factorize(rows["lang"])
        sources, source_names = pd.factorize(rows["source"])
        ords, p, p0 = (rows[c].to_numpy() for c in ("ord", "p", "p0"))
        for d in range(1, len(rows)):
            i = np.flatnonzero(ords[d:] == ords[:-d])
            if not len(i):
                break
            for a, b in ((i, i + d), (i + d, i)):
                value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                code = (langs[a] * len(source_names) + sources[a]) * len(source_names) + sources[b]
                kinds, inverse = np.unique(code, return_inverse=True)
                total = np.zeros(len(kinds), np.int64)
                np.add.at(total, inverse, value)
                item, source, lang = kinds % len(source_names), kinds // len(source_names) % len(source_names), kinds // len(source_names) ** 2
                names = lang_names.take(lang), source_names.take(source), source_names.take(item)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in names), pa.array(total)], schema=schema)

    rest: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        rest.append(batch)
        held += batch.num_rows
        if held >= PAIR_ROWS:
            rows = pa.Table.from_batches(rest)
            ords = rows.column("ord").to_numpy()
            cut = int(np.searchsorted(ords, ords[-1]))
            yield from sums(rows.slice(0, cut).to_pandas())
            rest = rows.slice(cut).to_batches()
            held = len(rows) - cut
    if held:
        yield from sums(pa.Table.from_batches(rest).to_pandas())


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """f summed over all kept terms for each two sources of a language.

    Most terms are in few sources. So the sum starts as if no term were in either source, is corrected by a histogram of each source's
    counts for the terms in it, and by the terms in both sources for those.
    """
    ends = groups.select("lang", "source", "p0", "terms")
    other = ends.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = ends.join(other, "lang").where("source <> item").select(
        "lang", "source", "item", F.coalesce(F.col("terms").cast("decimal(38,0)") * _f(F.col("p0"), F.col("q0")).cast("decimal(19,0)"), F.lit(0)).alias("value"))
    histogram = counts.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    ways = histogram.join(other, "lang").where("source <> item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")

    def times(value: Column) -> Column:
        return value.cast("decimal(20,0)") * F.col("k").cast("decimal(18,0)")

    there = F.struct(F.col("source").alias("source"), F.col("item").alias("item"), times(_f(p, q0) - _f(p0, q0)).alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), times(_f(q0, p) - _f(q0, p0)).alias("value"))
    single = ways.select("lang", F.explode(F.array(there, back)).alias("w")).select("lang", "w.*")
    n = partitions(groups.sparkSession)
    joint = counts.select("lang", "source", "ord", "p", "p0").repartition(n, "ord").sortWithinPartitions("ord").mapInArrow(
        _joint, "lang string, source string, item string, value bigint")
    parts = [x.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")) for x in (base, single, joint)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))


def audit(docs: DataFrame, *, min_docs: int = 3, top: int = 200) -> DataFrame:
    """Per language and source: its divergence from each other source (part `pair`) and the `top` terms it has more of than the language
    as a whole (part `term`), as (lang, source, part, item, value, rank).

    Null texts, languages and sources are read as empty; repeated rows are documents of their own; an empty table gives an empty result,
    and a language without kept terms gives pairs of value 0. Only text, lang and source are read. Equal values are ranked by the
    ordinal of the term, which is its place in byte order, or by the name of the source. A language's pairs of sources are the result
    itself, so their number is the square of its sources; no other step compares members of a group with each other.
    """
    blocks = vocabulary(docs, min_docs)
    counts = stage(recount(docs, blocks))
    spelled = stage(terms(blocks))
    kept = spelled.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = stage(_rows(docs, "lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms")).withColumn(
        "p0", probability(zero, F.col("total"), F.col("terms"))))
    rated = stage(counts.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms"))))
    pair = _pairs(groups, rated)
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    of_lang = counts.groupBy("lang", "ord").agg(F.sum("n").alias("lang_n")).join(whole, "lang")
    judged = rated.join(of_lang, ["lang", "ord"]).withColumn("q", probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    listed = judged.where("p > q").select("lang", "source", "ord", _f(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    named = listed.join(spelled.select("ord", F.col("term").alias("item")), "ord").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).unionByName(named)
