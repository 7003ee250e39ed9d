"""Divergence audit, spelling variants and vector packing against brute force, and their registered queries."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check
from conftest import SF
from packetloom.llm import common, divergence_audit, fragment_join, fuzzy_lines, queries, spelling_groups, vector_packing
from packetloom.llm.divergence_audit import Transducer
from packetloom.llm.queries import tokenizer_path
from packetloom.llm.vector_packing import Limits

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    stems = ["governor", "governour", "governer", "committee", "comittee", "committe", "überfluss", "uberfluss", "aaaaaaaa", "aaaaaaaaa", "aaaaaaaab", "naïveté", "日本語"]
    out = []
    for i in range(120):
        words = [rng.choice(stems[:3] if rng.random() < 0.7 else stems) for _ in range(rng.randint(0, 60))]
        out.append((i, rng.choice([" ", "\n", ", ", "1"]).join(words), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b", "c", None]), 1))
    out += [(900, None, "en", "lone", None), (901, "", "xx", "y", 0), (902, "only once here", "xx", "z", 0), (None, "governor " * 30, "en", "a", None),
            (903, "GOVERNOR " * 5000, "en", "a", 1), (904, "w" * 100_000, "en", "b", 1), (905, "a\0b ퟿÷×", "q\0r", "s\0", 1)]
    return out + [out[0], out[0], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "n", "word", "ord", "group", "start", "length", "ids", "p", "first")})


def audited(rows, min_docs=3, top=200):
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall(low(text))
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in in_docs[lang].items() if n >= min_docs), key=str.encode)
        of = {s: Counter({t: counts[lang, s][t] for t in kept}) for x, s in groups if x == lang}
        of[None] = sum(of.values(), Counter())
        total = {s: sum(c.values()) for s, c in of.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in of.items()}
        for s in of.keys() - {None}:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in of.keys() - {None, s}]
            more = [(t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if of[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pair, None), ("term", more, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("block", [divergence_audit.BLOCK_KEYS, 3])
def test_audit(docs, rows, monkeypatch, block):
    monkeypatch.setattr(divergence_audit, "BLOCK_KEYS", block)
    got = [tuple(r) for r in divergence_audit.audit(docs, top=7).collect()]
    want = audited(rows, top=7)
    assert len(got) == len(want) and set(got) == want


def test_audit_in_small_pieces(docs, rows, monkeypatch):
    for name in ("HELD_TERMS", "STREAM_TERMS", "PAIR_ROWS"):
        monkeypatch.setattr(divergence_audit, name, 5)
    assert {tuple(r) for r in divergence_audit.audit(docs, min_docs=1).collect()} == audited(rows, 1)


def test_audit_of_nothing(docs):
    assert divergence_audit.audit(docs.limit(0)).count() == 0
    blank = docs.where("doc_id = 900").withColumn("lang", F.lit(None).cast("string"))
    assert divergence_audit.audit(blank).count() == 0


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 7))) for _ in range(400)} | {"ü€".encode()})
    machine = Transducer.load(Transducer.of(keys).dump())
    assert list(machine.keys()) == keys
    others = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    asked = [k for k in keys if k] + others
    place = {k: i for i, k in enumerate(keys)}
    assert machine.ordinals(b"", b" ".join(asked) + b" ").tolist() == [place.get(k, -1) for k in asked]
    assert machine.ordinals(b"ab", b"c ca x ").tolist() == [place.get(k, -1) for k in (b"abc", b"abca", b"abx")]
    # No two states accept the same endings: as many states as there are different sets of endings.
    endings = defaultdict(set)
    for k in keys:
        for i in range(len(k) + 1):
            endings[k[:i]].add(k[i:])
    assert len(machine.final) == len({frozenset(e) for e in endings.values()})


def test_transducer_of_one_and_none():
    assert list(Transducer.of([b""]).keys()) == [b""]
    assert Transducer.of([]).ordinals(b"", b"a b ").tolist() == [-1, -1]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows, times=10):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", low(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        best = min(others, default=None)
        out[w] = (best[1], n, len(others), -best[0]) if best and -best[0] >= times * n else (None, n, len(others), None)
    done = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        done.add((w, form, root, n, n_near, form_n))
    return done


@pytest.mark.parametrize("times", [10, 2])
def test_spelling(docs, rows, times):
    got = [tuple(r) for r in spelling_groups.group_variants(docs, times=times).collect()]
    want = variants(rows, times)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want) == (times == 2)


def test_spelling_of_dense_words(spark):
    """Many neighbours of a word, ties, equal letters side by side, and a chain of forms."""
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(7 + i % 3)) for i in range(600)] + ["chained"] * 4000 + ["chainef"] * 300 + ["chaingf"] * 20 + ["chainggf"] * 2
    rows = [(i, " ".join(words[lo:lo + 50]), None, None, None) for i, lo in enumerate(range(0, len(words), 50))]
    got = {tuple(r) for r in spelling_groups.group_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == variants(rows)
    assert {r[0]: r[2] for r in got}["chainggf"] == "chained"


def test_spelling_of_nothing(docs):
    assert spelling_groups.group_variants(docs.limit(0)).count() == 0
    assert spelling_groups.group_variants(docs.where("text is null or text = ''")).count() == 0


def placed(items, limits, sequences, cut):
    parts = defaultdict(list)
    for held in sequences:
        total = sum(p[2] for p in held)
        assert 0 < total <= limits.tokens and len(held) <= limits.segments and sum(p[2] - p[3] for p in held) <= limits.loss
        assert not cut or total == limits.tokens or total & (total - 1) == 0
        for item, start, length, silent in held:
            parts[item].append((start, length, silent))
    for item, _, length, silent in items:
        at = 0
        for start, n, quiet in sorted(parts[item]):
            assert start == at and n > 0 and quiet == min(max(silent - at, 0), n)
            at += n
        assert at == length and (cut or len(parts[item]) == 1)


@pytest.mark.parametrize("seed", range(30))
def test_fill_keeps_all_limits(seed):
    rng = random.Random(seed)
    limits = Limits(rng.choice([1, 16, 64, 100]), rng.randint(1, 6), rng.randint(1, 80))
    items = []
    for i in range(rng.randint(0, 80)):
        n = rng.randint(1, limits.tokens)
        items.append((i, 0, n, rng.randint(0, n)))
    placed(items, limits, vector_packing.fill(items, limits), True)
    whole = limits._replace(loss=limits.tokens)
    placed(items, whole, vector_packing.fill(items, whole, False), False)


def test_fill_balances_the_limits():
    """Long prompts with short answers beside the reverse: by the dot product both kinds meet in each bin, which first fit misses."""
    limits = Limits(100, 10, 60)
    items = [(i, 0, 50, 45) for i in range(40)] + [(40 + i, 0, 50, 0) for i in range(40)]
    sequences = vector_packing.fill(items, limits, False)
    placed(items, limits, sequences, False)
    assert len(sequences) == 40


def expected_ids(texts, name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(tokenizer_path(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


ODD = ["a <|endoftext|>  b", "x\x1cy \x1c z", "\t\ttab\t x", "a b   c", " lead", "trail  ", "\n\n", "it's 'll  's ' s", "é́ 日本 語", "a\r\nb", "1 22  333", "\x85 n\x0bv", "naïve's ª º÷× ñandú'll", "'re'LL \x00\x7f a"]


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "B", "ñ", "'ll", "ª", "×", "\0", " ", "  ", "\n", "\t", "'s", "7", "é", " ", "\x1d", "!", "<|endoftext|>", " "]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    encoder = vector_packing.ChunkIds(tokenizer_path("byte_bpe_50k.json"))
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert got == [x[:-1] for x in expected_ids(texts)]


def test_rows_of_a_language_go_through_a_transducer_together(monkeypatch):
    keys = [b"de\0ab", b"de\0b", b"en\0ab", b"en\0c"]
    row = lambda lang, source, terms: {"base": None, "machine": None, "lang": lang, "source": source, "terms": b"".join(x + b" " for x in terms),
                                       "counts": np.arange(1, len(terms) + 1).tobytes()}
    start = lambda base: {"base": base, "machine": Transducer.of(keys).dump(), "lang": None, "source": None, "terms": None, "counts": None}
    rows = [start(0), *[row("de", f"s{k}", [b"ab", b"aa", b"b"]) for k in range(50)], row("en", "s0", [b"c"]), start(10), row("en", "s1", [b"no"]), row("en", "s1", [b"ab"])]
    schema = pa.schema([("base", pa.int64()), ("machine", pa.binary()), ("lang", pa.string()), ("source", pa.string()), ("terms", pa.binary()), ("counts", pa.binary())])
    run = lambda: list(divergence_audit._recount(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    want = [x for k in range(50) for x in (("de", f"s{k}", 0, 1), ("de", f"s{k}", 1, 3))] + [("en", "s0", 3, 1), ("en", "s1", 12, 1)]
    assert len(run()) == 3 and [tuple(r.values()) for b in run() for r in b.to_pylist()] == want
    monkeypatch.setattr(divergence_audit, "STREAM_BYTES", 10)
    assert len(run()) > 3 and [tuple(r.values()) for b in run() for r in b.to_pylist()] == want


def test_chunks_seen_again_stay_known_and_missing_ones_are_encoded_together(monkeypatch):
    monkeypatch.setattr(vector_packing, "CACHED_CHUNKS", 40)
    encoder = vector_packing.ChunkIds(tokenizer_path("byte_bpe_50k.json"))
    calls, encode_all = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: calls.extend(texts) or encode_all(texts))
    texts = [f"first{k} again often\u00f1 " + " ".join(f"w{k}x{i}" for i in range(12)) + "  <|endoftext|> z\n" for k in range(20)]
    for text in texts:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == want
        assert len(encoder.known) + len(encoder.earlier) <= 60
    # Only what begins a text or ends in white space is encoded alone; " again" is known from the first text on.
    assert all(x[0] != " " or x[-1].isspace() for x in calls) and (" again" in encoder.known or " again" in encoder.earlier)


@pytest.mark.parametrize("limits,prompt", [(Limits(), None), (Limits(64, 5, 40), "lang")])
def test_packed_examples_round_trip(spark, rows, docs, limits, prompt):
    odd = spark.createDataFrame([(2000 + i, x, None, None, None) for i, x in enumerate(ODD)], SCHEMA)
    given = docs.unionByName(odd, allowMissingColumns=True)
    found = vector_packing.pack_examples(given, tokenizer_path("byte_bpe_50k.json"), limits, prompt=prompt, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    for held in sequences.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
        assert (at == limits.tokens or at & (at - 1) == 0) and len(held) <= limits.segments and sum(x[2] for x in held) <= limits.loss
    texts = [(r[0], r[1], r[2]) for r in rows] + [(2000 + i, x, None) for i, x in enumerate(ODD)]
    after = expected_ids([t for _, t, _ in texts])
    before = [x[:-1] for x in expected_ids([p for *_, p in texts])] if prompt else [[]] * len(texts)
    want = Counter((d, tuple(a + b)) for (d, *_), a, b in zip(texts, before, after, strict=True))
    whole, copies = defaultdict(list), Counter(d for d, *_ in texts)
    for r in found:
        whole[r.doc_id].append((r.start, r.doc_tokens, tuple(np.frombuffer(r.ids, "<u2").tolist())))
    for (doc, ids), n in want.items():
        if copies[doc] == n:
            pieces = Counter()
            for start, total, part in whole[doc]:
                assert total == len(ids) and ids[start:start + len(part)] == part
                pieces.update(range(start, start + len(part)))
            assert pieces == Counter({i: n for i in range(len(ids))})
    assert sum(len(p[2]) for w in whole.values() for p in w) == sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r.loss_tokens for r in found) == sum(map(len, after))


def test_packing_refuses_and_takes_nothing(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    assert vector_packing.pack_examples(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        vector_packing.pack_examples(docs, path, Limits(10, 0, 5))
    with pytest.raises(ValueError):
        vector_packing.pack_examples(docs, path, Limits(10, 5, 5), cut=False)


@pytest.mark.parametrize("name", ["op11_divergence_audit", "op12_spelling_groups"])
def test_registered_queries_match_sql(spark, name):
    status, _, note = check.compare(spark, check.connect(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert status == "ok", note


def test_registered_packing(spark):
    found = queries.QUERIES["op13_vector_packing"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip((r.doc_id for r in docs), expected_ids([r.text for r in docs]), strict=True))
    for doc, pieces in found.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    assert set(found.doc_id) == set(ids)
    for total in found.groupby("sequence_id").length.sum():
        assert total == 2048 or total & (total - 1) == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        conf = {}

        class sparkContext:
            master = "local[4]"
            getCheckpointDir = staticmethod(lambda: None)

    assert common.shared_folder(Session) == common.shared_folder(Session)
    monkeypatch.setattr(Session.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="share"):
        common.shared_folder(Session)
    monkeypatch.setattr(Session.sparkContext, "getCheckpointDir", staticmethod(lambda: "hdfs:/given/"))
    assert common.shared_folder(Session) == "hdfs:/given"
    monkeypatch.setattr(Session, "conf", {"spark.checkpoint.dir": "s3://named"})
    assert common.shared_folder(Session) == "s3://named"


def test_a_chunk_is_looked_up_once_however_often_it_occurs():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encoder = vector_packing.ChunkIds(tokenizer_path("byte_bpe_50k.json"))
    given = ["the same few words " * 500, "the same words again", "a\x1cb the same"]
    want = encoder.encode(given)
    encoder.known = Counted(encoder.known)
    assert encoder.encode(given) == want == [encoder._encode([x])[0] for x in given]
    assert encoder.known.asked <= 10


def test_texts_of_a_batch_are_held_in_runs_of_bounded_size():
    texts = ["a line\n" + "b" * 600_000, None, "", "c\nd", "e" * 3_000_000, "f\n" + "b" * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([9] * 6, pa.int64()), pa.array(texts)], ["doc_id", "at", "text"])
    for part, first in ((batch, 0), (batch.slice(1), 1)):
        runs = list(common.runs_of(part))
        assert [x for _, run in runs for x in run] == [(x or "").encode() for x in texts[first:]]
        assert [lo for lo, _ in runs] == np.cumsum([0] + [len(run) for _, run in runs[:-1]]).tolist()
        assert all(len(run) == 1 or sum(map(len, run)) <= 1 << 20 for _, run in runs)
    found = list(fuzzy_lines._split(iter([batch])))
    assert len(found) == 3 and [(d, p) for b in found for d, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)] == [
        (0, 0), (0, 1), (3, 0), (3, 1), (4, 0), (5, 0), (5, 1)]
    sets = list(fragment_join._sets(iter([batch])))
    assert [b.num_rows for b, _ in sets] == [4, 1, 1] and [len(s) for _, x in sets for s in x] == [1, 0, 0, 1, 1, 1]
