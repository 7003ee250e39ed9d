"""Jaccard self-join of documents on word n-grams, vertically partitioned: the global n-gram order is cut into fragments.

Each fragment sees only its part of every document. Fragments file the necessary prefixes, which gives groups of documents that share
an n-gram, and count the partial overlaps of candidate pairs, which are summed per pair. Documents with equal sets are one node.
Groups are resolved through hubs before any pair inside them is formed, so a family of copies costs as many pairs as it has members;
only pairs that still lie in different components are then formed in full, so no link between components can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import LOWER, WordHashes, batches_of, components, connect, lean, mix, partitions, runs_of, signed, stage, windows

WORDS = 5
#: Similarity as a fraction, 75 / 100.
NEED, OF = 75, 100
#: n-grams gathered by a task before it hands them on; bounds its memory.
BLOCK = 3_000_000
#: Counters of the sketch of n-gram frequencies, 4 bytes each, in PIECES rows. It only steers the global order; any order is right.
COUNTERS, PIECES = 1 << 20, 16
#: Entries of a fragment on average.
FRAGMENT = 1_000_000


def gram_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The distinct word n-grams of a text as sorted 64-bit hashes; a text of fewer words is one n-gram."""
    h = hashes.of(words)
    if not len(h):
        return h
    return np.unique(windows(h, WORDS)) if len(h) >= WORDS else windows(h, len(h), base=0xD1342543DE82EF95)


def signature(grams: np.ndarray) -> int:
    """64 bits that name a set."""
    if not len(grams):
        return 0
    both = np.array([mix(grams).sum(dtype=np.uint64), np.bitwise_xor.reduce(grams)], np.uint64)
    return int(signed(windows(both, 2))[0]) or 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes()
    for batch in batches:
        for lo, raws in runs_of(batch):
            yield batch.slice(lo, len(raws)), [gram_set(x.translate(LOWER).split(), hashes) for x in raws]


_SIGNED = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])


def counter_of(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) % np.uint64(COUNTERS)).astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its set's size and name, and rows with the task's counts of all n-grams of its distinct sets."""
    total = np.zeros(COUNTERS, np.int64)
    seen: set[int] = set()
    for batch, sets in _sets(batches):
        names = [signature(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()),
                                          pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=_SIGNED)
        if len(seen) > 500_000:
            seen.clear()
        new = [s for name, s in zip(names, sets, strict=True) if name not in seen and not seen.add(name)]
        if new:
            total += np.bincount(counter_of(np.concatenate(new)), minlength=COUNTERS)
    cut = np.minimum(total, 0xFFFFFFFF).astype("<u4").reshape(PIECES, -1)
    yield from batches_of(_SIGNED, ({"doc_id": None, "at": None, "n_shingles": None, "sig": None, "piece": i, "counts": cut[i].tobytes()} for i in range(PIECES) if cut[i].any()))


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // PIECES, np.int64)
    for raw in pdf["counts"]:
        total += np.frombuffer(raw, "<u4")
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})


def frequencies(signed_rows: DataFrame) -> np.ndarray:
    """Estimated document frequency by counter, over all documents: the tasks' counts added up, 8 bytes a counter."""
    sums = signed_rows.where("piece is not null").select("piece", "counts").groupBy("piece").applyInPandas(_added, "piece int, counts binary")
    out = np.zeros((PIECES, COUNTERS // PIECES), np.int64)
    for row in sums.collect():
        out[row.piece] = np.frombuffer(row.counts, "<i8")
    return out.ravel()


_ENTRIES = pa.schema([("frag", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])


def _prefixes(common, n_frag: int):
    """Files the necessary prefix of every set: in the global order by (frequency, hash), all but as many as must overlap, and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_first = common.value
        keys: list[np.ndarray] = []
        sigs: list[int] = []
        sizes: list[int] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key, n = np.concatenate(keys), np.array([len(k) for k in keys])
            doc = np.repeat(np.arange(len(keys), dtype=np.uint32), n)
            frag = fragment_of(key, n_frag)
            order = np.lexsort((key, frag))
            key, doc, frag = key[order], doc[order], frag[order]
            cut = np.searchsorted(frag, np.arange(n_frag + 1))
            sig, size = np.array(sigs, np.int64), np.array(sizes, np.uint32)

            def rows() -> Iterator[dict]:
                for f in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[f], cut[f + 1])
                    used, local = np.unique(doc[part], return_inverse=True)
                    blob = key[part].tobytes() + local.astype(np.uint32).tobytes() + sig[used].tobytes() + size[used].tobytes()
                    yield {"frag": int(f), "n": int(cut[f + 1] - cut[f]), "blob": blob}

            yield from batches_of(_ENTRIES, rows())
            keys.clear()
            sigs.clear()
            sizes.clear()
            seen.clear()

        total = 0
        for _, sets in _sets(batches):
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            df = rare_first[counter_of(flat)]
            at = 0
            for grams in sets:
                n = len(grams)
                own, at = df[at:at + n], at + n
                name = signature(grams)
                if not n or name in seen:
                    continue
                seen.add(name)
                p = n - -(-NEED * n // OF) + 1
                keys.append(grams[np.lexsort((grams, own))[:p]])
                sigs.append(name)
                sizes.append(n)
                total += p
            if total >= BLOCK:
                yield from flush()
                total = 0
        yield from flush()

    return run


def fragment_of(grams: np.ndarray, n_frag: int) -> np.ndarray:
    return ((grams >> np.uint64(40)) * np.uint64(n_frag) >> np.uint64(24)).astype(np.int32)


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups of two or more sets that share an n-gram of the fragment; groups of the same members once, with their number."""
    keys, sigs, sizes = [], [], []
    for n, raw in zip(pdf["n"], pdf["blob"], strict=True):
        n = int(n)
        local = np.frombuffer(raw, np.uint32, n, 8 * n)
        docs = (len(raw) - 12 * n) // 12
        keys.append(np.frombuffer(raw, np.uint64, n))
        sigs.append(np.frombuffer(raw, np.int64, docs, 12 * n)[local])
        sizes.append(np.frombuffer(raw, np.uint32, docs, 12 * n + 8 * docs)[local])
    key, sig, size = np.concatenate(keys), np.concatenate(sigs), np.concatenate(sizes)
    order = np.lexsort((sig, key))
    key, sig, size = key[order], sig[order], size[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    key, sig, size = key[new], sig[new], size[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    keep = np.repeat(n > 1, n)
    sig, size, n = sig[keep], size[keep], n[n > 1]
    if not len(n):
        return pd.DataFrame({"gid": sig, "sig": sig, "size": size.astype(np.int32), "weight": sig})
    start = np.cumsum(n) - n
    name = signed(mix(np.add.reduceat(mix(sig.view(np.uint64)), start) + n.astype(np.uint64)))
    _, chosen, alike = np.unique(name, return_index=True, return_counts=True)
    weight = np.zeros(len(n), np.int64)
    weight[chosen] = alike
    rows = np.repeat(weight > 0, n)
    return pd.DataFrame({"gid": np.repeat(name, n)[rows], "sig": sig[rows], "size": size[rows].astype(np.int32), "weight": np.repeat(weight, n)[rows]})


_SEGMENTS = pa.schema([("sig", pa.int64()), ("frag", pa.int32()), ("grams", pa.binary())])
#: Texts whose hashes are sent to the executors, at most (8 bytes each); beyond, they are joined.
SENT = 1_000_000
#: Fragments of the verification: a hub's part of a set is joined and counted in as many places.
PARTS = 4


def _segments(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if wanted is not None:
                    batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), wanted.value)))
                if batch.num_rows:
                    yield batch

        def rows() -> Iterator[dict]:
            for _, sets in _sets(chosen()):
                for grams in sets:
                    name = signature(grams)
                    if name in seen:
                        continue
                    seen.add(name)
                    cut = np.searchsorted(fragment_of(grams, PARTS), np.arange(PARTS + 1))
                    for f in range(PARTS):
                        yield {"sig": name, "frag": f, "grams": grams[cut[f]:cut[f + 1]].tobytes()}

        yield from batches_of(_SEGMENTS, rows())

    return run


def segments(rows: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the pairs' members, cut into PARTS. The texts' hashes are sent if they are few, else joined."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = stage(named.join(members, "sig").groupBy("sig").agg(F.min("at").alias("n_at")).select("n_at"))
    schema = "sig bigint, frag int, grams binary"
    if wanted.count() <= SENT:
        sent = rows.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()))
        cut = rows.select("at", "text").mapInArrow(lean(_segments(sent)), schema)
    else:
        cut = rows.join(wanted, F.col("at") == F.col("n_at"), "left_semi").select("at", "text").mapInArrow(lean(_segments(None)), schema)
    return stage(cut.dropDuplicates(["sig", "frag"]))


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["a", "b", "n"])


def plausible(shared: Column) -> Column:
    """Whether sets with so many n-grams in common in their prefixes can reach the similarity.

    What two sets share beyond the prefix that ends first is at most the rest of that set, ceil(0.75 n) - 1 of n.
    """
    rest = F.ceil(F.greatest("size_a", "size_b") * NEED / OF) - 1
    return (OF + NEED) * (shared + rest) >= NEED * (F.col("size_a") + F.col("size_b"))


def verified(pairs: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b, size_a, size_b) that reach the similarity: partial overlaps per fragment, summed per pair."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    cut = segments(rows, named, pairs)
    left = cut.select(F.col("sig").alias("a"), "frag", F.col("grams").alias("grams_a"))
    right = cut.select(F.col("sig").alias("b"), "frag", F.col("grams").alias("grams_b"))
    spread = pairs.select("a", "b", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])).alias("frag"))
    both = spread.join(right, ["b", "frag"]).join(left, ["a", "frag"]).select("a", "b", "grams_a", "grams_b")
    counts = both.mapInArrow(lean(_overlap), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    good = counts.join(pairs, ["a", "b"]).where(OF * F.col("n") >= NEED * (F.col("size_a") + F.col("size_b") - F.col("n")))
    return good.select("a", "b")


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, links): every document's set size and name `sig`, and links between names whose union spans all similar pairs.

    The links connect exactly the documents that similar pairs connect; they need not hold each similar pair.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    signed_rows = stage(rows.mapInArrow(lean(_sign), "doc_id bigint, at bigint, n_shingles bigint, sig bigint, piece int, counts binary"))
    named = signed_rows.where("sig is not null").select("doc_id", "at", "n_shingles", "sig")
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(frequencies(signed_rows))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    n_frag = max(partitions(spark), total // (4 * FRAGMENT))
    entries = rows.select("text").mapInArrow(lean(_prefixes(common, n_frag)), "frag int, n bigint, blob binary")
    groups = entries.groupBy("frag").applyInPandas(_groups, "gid bigint, sig bigint, size int, weight bigint")
    groups = stage(groups.groupBy("gid", "sig").agg(F.max("size").alias("size"), F.sum("weight").alias("weight")))
    found = connect(groups, lambda pairs: verified(pairs, rows, named), NEED, OF, plausible)
    return named.select("doc_id", "at", "n_shingles", "sig"), found


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts have no set, link with nothing and are their own component, as are rows whose id is null if they link with
    nothing (component null). Rows with equal texts or equal sets share a component, repeated rows each get a row, ids may repeat,
    an empty table gives an empty result, and only the two columns named are read.
    """
    named, found = links(docs, text, doc_id)
    roots = components(found).withColumnRenamed("node", "sig")
    rows = named.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = rows.where("sig <> 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "root", "left")
    own = F.when(F.col("sig") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without all but one of each component: the one with the smallest doc_id stays, all columns kept.

    Of rows that share that id and text one stays. Rows without words stay.
    """
    named, found = links(docs, text, doc_id)
    roots = components(found).withColumnRenamed("node", "sig")
    rows = named.where("sig <> 0").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "at")
    best = rows.groupBy("root").agg(F.min(place).alias("best")).select("best.doc_id", "best.at")
    alike = (F.col("doc_id").eqNullSafe(F.col("_d"))) & (F.col("at") == F.col("_at"))
    stay = named.where("sig <> 0").join(best.select(F.col("doc_id").alias("_d"), F.col("at").alias("_at")), alike, "left_semi")
    stay = stay.unionByName(named.where("sig = 0"))
    stay = stage(stay.groupBy("doc_id", "at").agg(F.count("*").alias("rows"), (F.first("sig") == 0).alias("free")))
    given = docs.select(F.struct("*").alias("_row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("at"))
    stay = stay.withColumnsRenamed({"doc_id": "_d", "at": "_at"})
    kept = given.join(stay, alike)
    if stay.where("rows > 1 and not free").isEmpty():
        return kept.select("_row.*")
    once = kept.where("rows > 1 and not free").groupBy("doc_id", "at").agg(F.first("_row").alias("_row"))
    return kept.where("rows = 1 or free").select("_row").unionByName(once.select("_row")).select("_row.*")
