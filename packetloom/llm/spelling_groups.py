"""Spelling variants of words found in a sorted list of all their rotations."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import partitions, stage

#: Latin-1 letters, A-Z in lower case, all else a space. Characters outside Latin-1 are encoded as question marks before.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Different words a task counts before it passes them on; bounds its memory.
HELD = 300_000

_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _count(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())}, schema=_COUNTED)
            counts.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                runs = Counter([w for w in text.encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least])
                seed = crc(b":", crc(doc.encode())) if doc is not None else crc(b":")
                for word, n in runs.items():
                    h = crc(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % every == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield flush()
        if counts:
            yield flush()

    return run


def vocabulary(docs: DataFrame, *, least_length: int = 7, least_n: int = 2, every: int = 31, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): the letter runs of all texts, one code point deleted where `every` divides the hash of document and run; those of at
    least `least_length` code points and `least_n` occurrences. A null id counts as an empty one, a null text as none."""
    rows = docs.select(F.col(doc_id).cast("string"), F.col(text))
    counted = rows.mapInArrow(_count(least_length, every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """The rotations of every word with a terminator, as (key, edited, first, n).

    A rotation at a gap between letters is the key of the word itself, with nothing edited. A rotation that ends in a letter is filed
    under its prefix without that letter: words that share this prefix differ in the letter only, and the word whose own rotation
    it is lacks the letter. `first` tells that the letter is the first of equal neighbours, so that each insertion counts once.
    """
    at = words.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("word"))))
    before, letter = F.expr("substr(word, 1, i)"), F.expr("substr(word, i + 1, 1)")
    own = F.struct(F.expr("concat(substr(word, i + 1), '$', substr(word, 1, i))").alias("key"), F.lit("").alias("edited"), F.lit(False).alias("first"))
    cut = F.struct(F.concat(F.expr("substr(word, i + 2)"), F.lit("$"), before).alias("key"), letter.alias("edited"),
                   (F.expr("i = 0") | (F.expr("substr(word, i, 1)") != letter)).alias("first"))
    both = F.when(F.col("i") < F.length("word"), F.array(own, cut)).otherwise(F.array(own))
    return at.select(F.explode(both).alias("r"), "n").select("r.key", "r.edited", "r.first", "n")


def _two_best(members: list[tuple]) -> tuple[tuple, tuple | None]:
    """The members with the largest counts, ties by the edited letter."""
    ordered = sorted(members, key=lambda m: (-m[2], m[0]))
    return ordered[0], ordered[1] if len(ordered) > 1 else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in the sorted rotations, each at most one word and one longer word per letter, give each member the number
    of its neighbours and the best of them."""

    def group(key: str, members: list[tuple], out: list[tuple]) -> None:
        tail, _, head = key.partition("$")
        own = members[0] if members[0][0] == "" else None
        edited = members[1:] if own else members
        spelled = {m[0]: head + m[0] + tail for m in edited}
        if len(edited) > 1:
            one, two = _two_best(edited)
            for m in edited:
                other = two if m is one else one
                out.append((spelled[m[0]], len(edited) - 1, other[2], spelled[other[0]]))
        first = [m for m in edited if m[1]]
        if own and first:
            one, _ = _two_best(first)
            out.append((head + tail, len(first), one[2], spelled[one[0]]))
            out.extend((spelled[m[0]], 1, own[2], head + tail) for m in first)

    def found(table: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        key, members = None, []
        for k, *m in zip(*(table.column(c).to_pylist() for c in ("key", "edited", "first", "n")), strict=True):
            if k != key:
                if members:
                    group(key, members, out)
                key, members = k, []
            members.append(tuple(m))
        if members:
            group(key, members, out)
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NEAR, strict=True)], schema=_NEAR)

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        keys = rows.column("key").combine_chunks()
        if len(keys) < 2:
            rest = rows
            continue
        same = pc.equal(keys[1:], keys[:-1])
        no, yes = pa.array([False]), pa.array([True])
        shared = pc.or_(pa.concat_arrays([no, same]), pa.concat_arrays([same, no]))
        # The last key may go on in the next batch.
        starts = pc.indices_nonzero(pa.concat_arrays([yes, pc.invert(same)]))
        cut = starts[len(starts) - 1].as_py()
        rest = rows.slice(cut)
        yield found(rows.slice(0, cut).filter(shared[:cut]))
    if rest is not None:
        yield found(rest)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words that have near words: how many, and the one with the largest n (ties: the smallest)."""
    n = partitions(words.sparkSession)
    ordered = rotations(words).repartitionByRange(n, "key").sortWithinPartitions("key", "edited")
    near = ordered.mapInArrow(_scan, "word string, n_near bigint, near_n bigint, near string")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end. Every round doubles the steps; a chain has few, as counts grow tenfold."""
    now = stage(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stage(now.drop("moved").join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return now.select("word", "root")


def group_variants(docs: DataFrame, *, times: int = 10, **how) -> DataFrame:
    """Every word with its count, its number of near words (one code point inserted, deleted or replaced), its form and its root.

    form is the near word with the largest n where that is at least `times` the word's own, root is where the forms lead to. The
    rotations of all words are sorted into ranges; a run of equal keys has at most one member per letter and one more, so no group
    grows with the data. Null and empty texts have no words, repeated rows count again, an empty table gives an empty result; only
    the id and the text column are read. Words of any length are kept whole.
    """
    words = stage(vocabulary(docs, **how))
    near = neighbours(words)
    is_form = F.col("near_n") >= times * F.col("n")
    formed = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
