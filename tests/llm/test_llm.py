"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import (
    blob_ledger, chat_format, decontamination, fragment_join, fuzzy_lines, host_extraction, host_quality, resharding, swap_packing, trie_scoring,
)
from packetloom.llm.queries import tokenizer_path

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30 ", "x30 ")
FAR = " ".join(f"v{i}" for i in range(60))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    texts = [BASE, NEAR, FAR, BASE, None, "", " \n\t ", "one", "One", "two words", FAR + " " + BASE, "é" * 50 + " ü", (BASE + "\n") * 3,
             "x " * 3000, "password = hunter22secret token:abc", "AKIA" + "B7" * 9 + " " + "0123456789abcdef" * 2]
    out = [(i, t, "en", "src0" if i % 3 else None, 7) for i, t in enumerate(texts)]
    return out + [out[0], (None, NEAR, None, "lone", None), (900, BASE.upper(), "en", "src9", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_extraction_of_marked_and_unmarked_pages(spark):
    frame = "<div>Home About Contact Imprint Terms Privacy</div>{}<div>All rights reserved by the owner here</div>"
    pages = [(1, "http://a/1", frame.format("<div>A story that only page one tells</div>")), (2, "http://a/2", frame.format("<div>Another one that is new on two</div>")),
             (3, "http://b/1", "<nav>no</nav><article><h1>T &amp; U</h1><p><b>x<br><p>y\n z<aside>no</aside><div class='share'>no</div></article>"
                               "<section id=comments><article>I say</article></section><footer>no</footer>"),
             (4, None, None), (5, "x", ""), (5, "x", ""), (None, "http://c", "<main>" + "long " * 40000 + "</main>"), (7, "http://d", "<!-- <article>no</article> --><article>a<script>'</p>'</script>b")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text) for r in host_extraction.extract(df).collect()]
    want = [(1, "A story that only page one tells"), (2, "Another one that is new on two"), (3, "T & U\nx\ny z"), (4, ""), (5, ""), (5, ""),
            (None, ("long " * 40000).strip()), (7, "a b")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert host_extraction.extract(df.limit(0)).count() == 0


def test_suffix_classes_are_runs():
    rng = np.random.default_rng(1)
    tokens, stream = rng.integers(0, 3, 300).astype(np.uint64), np.repeat(np.arange(3), 100)
    classes = host_extraction.suffix_classes(tokens, stream, 4)
    named = {}
    for i in range(300):
        if i % 100 > 96:
            assert classes[i] == -1
        else:
            assert named.setdefault(tuple(tokens[i:i + 4]), classes[i]) == classes[i]
    assert len(set(named.values())) == len(named)


def test_chat_round_trip(spark):
    import public_tokenizers

    turns = [(1, 0, "user", "</s>[INST] a [/INST] <|end|> <\\|turn|> \\"), (1, 1, "assistant", "<|text|>é\U0001f600" * 2000), (1, 2, None, None), (1, 3, "assistant", ""),
             (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "system", "<<SYS>>"), (3, 5000, "assistant", "late"), (3, 0, "assistant", "early")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit("clash"))
    how = (tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.segments(df, *how), *how).collect()}
    by = defaultdict(list)
    for t in sorted(turns, key=lambda t: (t[0] or -1, t[1] or 0)):
        by[t[0]].append(t)
    for conv, own in by.items():
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.segments(df.limit(0), *how), *how).count() == 0


@pytest.mark.parametrize("text", ["<s>", "<\\s>", "[\\\\/INST]", "<<SYS>><|a|>", "plain \\ <", "<</SYS>>[INST]"])
def test_escape_is_reversible(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    assert not any(c in hidden for c in ("<s>", "[/INST]", "[INST]", "<<SYS>>", "<</SYS>>", "<|a|>"))


def test_flow_moves_the_fewest_bytes():
    supply, capacity = [70, 10, 0], [20, 20, 20, 20]
    flow = resharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(4)] for i in range(3)])
    assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(4))
    assert sum(f[j] for i, f in enumerate(flow) for j in range(4) if i != j) == 50
    detour = resharding.min_cost_flow([5, 5], [5, 5], [[1, 2], [1, 9]])
    assert detour == [[0, 5], [5, 0]]


def test_resharding(spark, docs, empty, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 997).alias("bytes"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 4).alias("at"))
    out = resharding.reshard(rows, F.col("at"), F.col("bytes") + 8, ["doc_id"], [1.0] * 6, block_bytes=20_000)
    got = out.collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == 3000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 200
    old = Counter()
    for r in got:
        old[r.old] += r.size
    least = sum(max(0, old[i] - sizes.total() // 6) for i in old)
    assert sum(r.size for r in got if r.old != r.shard) < 1.02 * least
    path = str(tmp_path / "shards")
    assert resharding.rewrite_affected(out, path) == list(range(6)) and spark.read.parquet(path).count() == 3000
    few = docs.select("doc_id", "text", F.lit("clash").alias("shard"))
    assert resharding.reshard(few, F.lit(None), F.lit(8), ["doc_id"], [1.0, 1.0]).count() == docs.count()
    assert resharding.reshard(empty, F.lit(0), F.lit(8), ["doc_id"], [1.0]).count() == 0


def test_quality_counts(docs, rows, empty):
    got = host_quality.assess(docs.withColumn("n_words", F.lit("clash"))).collect()
    want = []
    for doc, text, _, host, _ in rows:
        text = text or ""
        words = SPACED.findall(text)
        seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want.append((doc, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, host))
    assert sorted([(r.doc_id, *(r[c] for c in host_quality.COUNTS), r.base_failed, r.host) for r in got], key=repr) == sorted(want, key=repr)
    assert all(not r.kept for r in got if r.base_failed) and {r.doc_id for r in got if r.kept} >= {0, 1, 2}
    kept = host_quality.clean(docs.withColumn("n_words", F.lit("clash")).withColumn("host", F.lit(1)))
    assert kept.columns == [*docs.columns, "n_words", "host"] and kept.count() == sum(r.kept for r in got)
    assert host_quality.assess(empty).count() == 0 and host_quality.clean(empty).count() == 0


def test_rates_shrink_towards_all_hosts(spark):
    rows = [("a", 30, 0)] * 90 + [("a", 3, 0)] * 10 + [("b", 3, 0)] + [("c", 3, 0)] * 95 + [("c", 30, 0)] * 5
    measured = spark.createDataFrame(rows, "_host string, n_words bigint, n_repeat_words bigint").withColumn("base_failed", F.col("n_words") < 20)
    rate = {r._host: r.shrunk_rate for r in host_quality.host_rates(measured).collect()}
    assert 0.1 <= rate["a"] < 0.3 and rate["b"] < 1 and 0.8 < rate["c"] <= 0.95


def test_lines(docs, spark, empty):
    line = " ".join(f"word{i}" for i in range(40))
    texts = [(1, f"{line}\nsame  LINE\n\nlast a"), (2, "same line\nlast b"), (3, line.replace("word7", "wordy")), (4, None), (5, ""), (6, "same line"), (6, "same line")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: r for r in fuzzy_lines.dedupe(df).collect()}
    assert got[1].text == f"{line}\nsame  LINE\n\nlast a" and got[2].text == "last b" and got[4].text is None and got[5].text == "" and got[6].text == ""
    assert (got[1].n_lines, got[2].n_dropped, got[6].n_dropped) == (4, 1, 1)
    out = fuzzy_lines.dedupe(docs).collect()
    assert len(out) == docs.count()
    kept = [" ".join(low(x).split()) for r in out if r.doc_id != 0 for x in (r.text or "").split("\n")]
    assert max(Counter(x for x in kept if x).values()) == 1
    assert fuzzy_lines.dedupe(empty).count() == 0


def test_lines_one_letter_apart_meet_where_simhash_agrees(spark):
    base = [" ".join(f"t{k}q{i}" for i in range(300)) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t[:-1] + "Z") for k, t in enumerate(base)]
    got = {r.doc_id: r.text for r in fuzzy_lines.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == t for k, t in enumerate(base)) and sum(got[100 + k] == "" for k in range(20)) >= 15


def edits(a, b):
    a, b = np.frombuffer(a.encode("utf-32"), np.uint32)[1:], np.frombuffer(b.encode("utf-32"), np.uint32)[1:]
    row, place = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, c in enumerate(a):
        step = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (b != c))])
        row = np.minimum.accumulate(step - place) + place
    return row[-1]


def test_lines_recall_against_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 10))) for _ in range(3000)]
    some = lambda n: rng.choices(words, [1 / (k + 5) for k in range(3000)], k=n)
    lines = []
    for k in range(240):
        base = some(rng.randint(20, 130))
        copy = list(base)
        for i in rng.sample(range(len(copy)), 1 if k % 3 == 0 else max(1, len(copy) // 12)):
            copy[i] = rng.choice(words) if k % 3 < 2 else copy[i][:-1] + "z"
        lines += [" ".join(base), " ".join(copy)]
    counts = [Counter(x[i:i + 3] for i in range(len(x) - 2)) for x in lines]  # an edit changes at most three of them
    similar = []
    for a, b in combinations(range(len(lines)), 2):
        most = max(len(lines[a]), len(lines[b])) // 10
        if abs(len(lines[a]) - len(lines[b])) <= most and sum((counts[a] - counts[b]).values()) <= 3 * most and edits(lines[a], lines[b]) <= most:
            similar.append((a, b))
    assert len(similar) >= 150
    got = fuzzy_lines.dedupe(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    dropped = {r.doc_id for r in got if r.text == ""}
    assert dropped <= {b for _, b in similar}
    assert sum(b in dropped for _, b in similar) >= 0.9 * len(similar)


def test_counts_rule_out_only_pairs_that_are_not_similar():
    """most candidates share the syllables of their language and no more; before, all of them met in an edit distance."""
    rng = random.Random(11)
    parts = [x + y for x in "bcdfglmnrst" for y in "aeiou\u00f3\u00e9"]
    some = lambda: [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(70)) for _ in range(60)]
    lines, others = some(), some()
    copies = []
    for k, line in enumerate(lines):
        letters = list(line)
        for i in rng.sample(range(len(letters)), len(letters) * (k % 10) // 100):
            letters[i] = rng.choice(["", "x", letters[i] + "\u6f22"])
        copies.append("".join(letters))
    one, other = [*lines, *lines, "", "ab"], [*copies, *others, "", "cd"]
    most = [max(len(x), len(y)) // 10 for x, y in zip(one, other, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(one))), pa.array(one), pa.array(other), pa.array(most, pa.int32())], ["a", "words_a", "words_b", "most"])
    for part in (batch, batch.slice(7)):
        kept = {x for b in fuzzy_lines._possible(iter([part])) for x in b.column(0).to_pylist()}
        similar = {x for x in part.column(0).to_pylist() if edits(one[x], other[x]) <= most[x]}
        assert similar <= kept and len(similar) > 50 and len(kept - similar) <= 6


def test_pairs_meet_their_texts_some_at_a_time(spark, monkeypatch):
    """before, the texts of all pairs were shuffled at once."""
    texts = spark.createDataFrame([(i, f"the same words in every line but {i:02d}" if i % 3 else f"{i} " * 13) for i in range(24)], "sig bigint, words string")
    pairs = spark.createDataFrame([(a, b) for a in range(24) for b in range(a + 1, 24)], "a bigint, b bigint")
    found = sorted(fuzzy_lines.verified(pairs, texts).collect())
    turns = []
    monkeypatch.setattr(fuzzy_lines, "PAIRS", 100)
    monkeypatch.setattr(fuzzy_lines, "stage", lambda df: turns.append(df) or df)
    assert sorted(fuzzy_lines.verified(pairs, texts).collect()) == found and len(found) == 16 * 15 // 2
    assert len(turns) == 3 and fuzzy_lines.verified(pairs.limit(0), texts).count() == 0


def test_workers_forget_what_another_step_kept(spark):
    """before, a worker kept the known words of the packing (200 MB) through all later steps."""
    from packetloom.llm.common import kept_by_worker, lean, stage

    def kept(batches):
        kept_by_worker("words", lambda: "many")
        yield from batches

    def held(batches):
        import sys

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sys.modules["_packetloom_worker"].kept)] * b.num_rows)], ["id"])

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["id"])
    count = lambda run: [b.column(0).to_pylist() for b in run(iter([batch]))]
    count(lean(kept, keeps=True))
    assert count(lean(held, keeps=True)) != [[0, 0]] and count(lean(held)) == [[0, 0]]
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    assert stage(spark.range(10).mapInArrow(lean(kept), "id bigint").repartition(2, "id")).count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before


def test_lines_of_common_endings_are_no_candidates():
    """Endings that most words share must not decide the signs; before, all these pairs were within the radius."""
    rng = random.Random(3)
    parts = [x + y for x in "bcdfglmnrst" for y in "aeiou"]
    word = lambda: "".join(rng.choices(parts, k=3)) + "ci\u00f3n"
    lines = [" ".join(word() for _ in range(60)).encode() for _ in range(60)]
    copies = [x[:-1] + b"z" for x in lines]
    one, other = (fuzzy_lines.LineBits().of(x) for x in (lines, copies))
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1)
    assert (apart(one, other) <= 8).all()
    a, b = np.triu_indices(len(lines), 1)
    assert (apart(one[a], one[b]) <= fuzzy_lines.RADIUS).mean() < 0.05


def test_lines_that_share_several_keys_make_one_group():
    rng = np.random.default_rng(1)
    sim = rng.integers(0, 1 << 63, (20, fuzzy_lines.BITS // 64)).astype(np.uint64).repeat(2, axis=0)
    sim[1::2] ^= np.uint64(1) << rng.integers(0, 64, (20, fuzzy_lines.BITS // 64)).astype(np.uint64)
    columns = [*sim.view(np.int64).T, np.full(40, 100, np.int32)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), pa.array(columns[-1]), *map(pa.array, columns[:-1])], ["line", "size", *"ab"])
    filed = pa.Table.from_batches(fuzzy_lines._file(64)(iter([batch]))).to_pandas()
    keys = np.stack([fuzzy_lines._key(sim, t) for t in range(fuzzy_lines.BLOCKS)])
    assert ((keys[:, ::2] == keys[:, 1::2]).sum(axis=0) > 1).all()
    found = pd.concat([fuzzy_lines._groups(part) for _, part in filed.groupby("frag")])
    assert sorted(found.groupby("gid")["sig"].apply(tuple)) == [(2 * k, 2 * k + 1) for k in range(20)]


def shingles(text):
    w = SPACED.findall(low(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def joined(rows):
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min((x for x in (least.get(find(i)), ids[i]) if x is not None), default=None)
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def test_join(docs, rows, empty):
    got = [tuple(r) for r in fragment_join.classes(docs.withColumn("sig", F.lit("clash"))).collect()]
    assert sorted(got, key=repr) == sorted(joined(rows), key=repr)
    stay = [r.doc_id for r in fragment_join.one_of_each(docs).collect()]
    assert sorted(stay) == sorted({c for _, n, c in joined(rows) if n} | {i for i, n, _ in joined(rows) if not n})
    assert fragment_join.classes(empty).count() == 0 and fragment_join.one_of_each(empty).count() == 0


def test_join_of_chains_and_a_common_passage(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for k in range(40):
        words = [f"d{k}x{i}" for i in range(30)] + passage
        for step in range(4):  # each differs a little from the one before, the ends differ a lot
            rows.append((len(rows) * 7 % 401, " ".join(words)))
            words = list(words)
            words[int(rng.integers(0, 30))] = f"e{k}x{step}"
    got = [tuple(r) for r in fragment_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(joined(rows))


def test_secrets(docs, rows, empty, tmp_path):
    rules = (("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))

    def brute(text):
        return sorted((m.start(), no, m.end(), kind) for no, (kind, p, g, n) in enumerate(rules) for m in p.finditer(text or "") if len(m[g]) >= n)

    ledger = str(tmp_path / "ledger")
    for _ in range(2):  # the second run finds every blob in the ledger
        got = blob_ledger.scan(docs.withColumn("sha", F.lit("clash")), ledger).collect()
        assert sorted([(r.doc_id, [tuple(f) for f in r.findings]) for r in got], key=repr) == sorted([(r[0], brute(r[1])) for r in rows], key=repr)
    held = docs.sparkSession.read.parquet(ledger)
    assert held.count() == held.select("sha").distinct().count() == len({r[1] or "" for r in rows})
    tricky = [(1, "secret: token: abcdefgh"), (2, "API_KEY='a.b-c=d/e' passwd=\tx"), (3, "aé token = 123456789 " + "f" * 30 + "g" + "AKIA" * 6)]
    df = docs.sparkSession.createDataFrame(tricky, "doc_id bigint, text string")
    assert {r.doc_id: [tuple(f) for f in r.findings] for r in blob_ledger.scan(df).collect()} == {i: brute(t) for i, t in tricky}
    assert blob_ledger.scan(empty).count() == 0


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(5, " ".join(f"W{i}" for i in range(25, 40))), (40, "Two, words!"), (41, "two-words"), (7, None), (8, "..."), (None, "v0 v1 v2"), (9, " ".join(["x"] * 12))]
    found = defaultdict(set)
    for item, text in items:
        w = word.findall(low(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            found[tuple(w[i:i + 10])].add(item)
    want = []
    for doc, text, *_ in rows:
        w = word.findall(low(text))
        at = [(i, k) for k in found for i in range(len(w) - len(k) + 1) if tuple(w[i:i + len(k)]) == k]
        want.append((doc, len(w), len({j for i, k in at for j in range(i, i + len(k))}), sorted({x for _, k in at for x in found[k] if x is not None})))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (32 << 20, 40):  # the second in several blocks
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", most)
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontamination.find(docs.withColumn("spans", F.lit("clash")), bench).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontamination.remove(docs, bench).count() == sum(n == 0 for _, _, n, _ in want)
    assert decontamination.remove(docs, bench.limit(0)).count() == len(rows) and decontamination.find(empty, bench).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = swap_packing.pack_documents(docs.withColumn("piece", F.lit("clash")), tokenizer_path(), with_ids=True).collect()
    want = []
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            raw = np.array(ids[lo:lo + 2048], "<u4").tobytes()
            want.append((doc, k, lo, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got], key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert swap_packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_swaps_empty_bins():
    lengths = [6, 6, 3, 3, 2]  # by hand: 6+3 and 6+3 leave 2 alone; nothing can be gained
    bins = swap_packing.best_fit(lengths, 10)
    assert sorted(i for b in swap_packing.local_search(bins, lengths, 10) for i in b) == list(range(5))
    worse = [[0, 1], [2, 3], [4, 5, 6]]
    sizes = [5, 2, 6, 2, 3, 1, 1]
    out = swap_packing.local_search([list(b) for b in worse], sizes, 10)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(7))
    rng = np.random.default_rng(5)
    many = [int(x) for x in rng.integers(300, 900, 400)]
    before = swap_packing.best_fit(many, 2048)
    after = swap_packing.local_search([list(b) for b in before], many, 2048)
    assert len(after) <= len(before) and all(sum(many[i] for i in b) <= 2048 for b in after) and sorted(i for b in after for i in b) == list(range(400))


def test_scoring(docs, rows, empty, tmp_path):
    tokens = [SPACED.findall(low(t)) + [None] for _, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, *_ in rows]
    c, pairs, after, kinds = Counter(), Counter(), Counter(), Counter()
    for t, out in zip(tokens, held, strict=True):
        if not out:
            c.update(t)
            pairs.update(zip(["<s>", *t], t))
    for (a, _), n in pairs.items():
        after[a] += n
        kinds[a] += 1
    n, v = sum(c.values()), len(c)
    got = sorted(trie_scoring.score(docs.withColumn("block", F.lit("clash")), block=500, save=str(tmp_path / "m")).collect(), key=repr)
    want = []
    for (doc, *_), t, out in zip(rows, tokens, held, strict=True):
        alone = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        full = [max(pairs[a, w] - 0.75, 0) / after[a] + 0.75 * kinds[a] / after[a] * p if after[a] else p for a, w, p in zip(["<s>", *t], t, alone)]
        want.append((doc, out, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, alone)), sum(map(math.log10, full))))
    for r, w in zip(got, sorted(want, key=repr), strict=True):
        assert tuple(r)[:5] == w[:5] and math.isclose(r.base_score, w[5], abs_tol=1e-9) and abs(r.score - w[6]) < 2e-4 * w[2]
    again = sorted(trie_scoring.score(docs, model=str(tmp_path / "m")).collect(), key=repr)
    assert [tuple(r)[:5] for r in again] == [tuple(r)[:5] for r in got] and all(math.isclose(a.score, b.score) for a, b in zip(again, got, strict=True))
    assert trie_scoring.score(empty).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in (np.sort(rng.integers(0, 1 << 50, 1000, dtype=np.uint64)), np.zeros(9, np.uint64), np.arange(5000, dtype=np.uint64),
                   np.sort(np.concatenate([rng.integers(0, 99, 3000), rng.integers(0, 1 << 40, 30)])).astype(np.uint64)):
        coded = trie_scoring.EliasFano(*trie_scoring.EliasFano.encode(values))
        assert (coded.access(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 50, 100, dtype=np.uint64)])
        place = coded.find(asked)
        assert ((place >= 0) == np.isin(asked, values)).all() and (values[place[place >= 0]] == asked[place >= 0]).all()


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"b{i}" for i in range(30))
    own = [(1000, "  ".join(f"c{i}" for i in range(50)), "en", "s", 1), (1001, passage + " " + FAR.replace("v", "z"), "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(own, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        frame = step(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns, name
    kept = {r.doc_id for r in frame.collect()}
    assert {0, 2, 1000} <= kept and not kept & {4, 5, 6, 7, 1001}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_ledger_keeps_rule_sets_apart_and_counts_a_blob_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "password: hunter22 key-1234"), (2, None)], "doc_id int, text string")
    ledger = str(tmp_path / "ledger")
    kinds = lambda rules: [[f.kind for f in r.findings] for r in blob_ledger.scan(docs, ledger, rules).orderBy("doc_id").collect()]
    assert kinds(blob_ledger.RULES) == [["assign"], []]
    assert kinds((("key", r"key-[0-9]+", 0, 4),)) == [["key"], []]
    assert kinds(blob_ledger.RULES) == [["assign"], []]
    held = spark.read.parquet(ledger)
    held.write.mode("append").parquet(str(tmp_path / "twice"))
    held.write.mode("append").parquet(str(tmp_path / "twice"))
    assert blob_ledger.scan(docs, str(tmp_path / "twice")).count() == 2


def test_ledger_places_many_findings_of_one_text(spark):
    import re
    import time
    text = "".join(f"secret = tok{i:06d}é{'0123456789abcdef' * 2 if i % 3 else ''}\n" for i in range(12_000))
    began = time.time()
    got = [(f.kind, f.start, f.end) for f in blob_ledger.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().findings]
    spent = time.time() - began
    want = [("assign", m.start(), m.end()) for m in re.finditer(r"secret\x20*=\x20*([A-Za-z0-9+/_.=-]+)", text)]
    want += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    assert len(got) == 20_000 and got == sorted(want, key=lambda f: (f[1], f[0] == "hex"))
    assert spent < 60


def test_base_score_without_training_rows_follows_its_formula(spark):
    held = next(i for i in range(100) if trie_scoring.held_out(i))
    r = trie_scoring.score(spark.createDataFrame([(held, "one two")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9
