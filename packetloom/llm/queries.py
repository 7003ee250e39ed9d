"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    blob_ledger,
    chat_format,
    decontamination,
    divergence_audit,
    fragment_join,
    fuzzy_lines,
    host_extraction,
    host_quality,
    resharding,
    spelling_groups,
    swap_packing,
    trie_scoring,
    vector_packing,
)
from packetloom.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_quality.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *host_quality.COUNTS, "base_failed", "kept", "host", "shrunk_rate")


@query
def op8_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op6_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_join.classes(table(spark, sf_dir, "documents"))


@query
def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query
def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blob_ledger.scan(table(spark, sf_dir, "documents"))
    kinds = [kind for kind, *_ in blob_ledger.BASE_RULES]

    def listed(items):
        return F.array_join(F.transform(items, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    counts = [F.expr(f"size(filter(findings, f -> f.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in kinds]
    base = F.filter("findings", lambda f: f["kind_no"] < len(kinds))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


@query
def op2_token_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    how = (tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chat_format.read_back(chat_format.segments(turns.unionByName(own), *how), *how)


@query
def op3_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "source")
    # The layout before: 16 shards by source, so the largest source fills one of them.
    placed = resharding.reshard(rows, F.pmod(F.xxhash64("source"), F.lit(16)), F.col("bytes") + 8, ["doc_id", "text_crc32"], [1.0] * 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


@query
def op1_host_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_removed")


@query
def op10_trie_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_scoring.score(table(spark, sf_dir, "documents"))


#: The audit by plain counting: every kept term against every group of its language.
_AUDIT_SQL = """with docs as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as (select lang, term from words group by all having count(distinct row) >= 3),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
sizes as (select lang, count(*) as v from kept group by all),
ends as (select g.lang, g.source, coalesce(t.total, 0) as total, coalesce(s.v, 0) as v from (select distinct lang, source from docs) g
  left join (select lang, source, cast(sum(n) as bigint) as total from counts group by all) t using (lang, source) left join sizes s using (lang)),
every as (select e.lang, e.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (e.total + e.v) as p
  from ends e join kept k using (lang) left join counts c using (lang, source, term)),
whole as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // (any_value(total) + any_value(v)) as q
  from every join (select lang, cast(sum(total) as bigint) as total, any_value(v) as v from ends group by all) using (lang) group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(f.value, 0) as value from ends a join ends b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
    from every x join every y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
  on f.lang = a.lang and f.source = a.source and f.item = b.source),
found as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from every join whole using (lang, term) where n > 0 and p > q),
listed as (select lang, source, 'pair' as part, item, cast(value as bigint) as value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', item, cast(value as bigint), row_number() over (partition by lang, source order by value desc, item) from found)
select lang, source, part, item, value, cast(rank as int) as rank from listed where part = 'pair' or rank <= 200"""
SQL["op11_divergence_audit"] = _AUDIT_SQL


@query
def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


#: The checksum bit by bit, words apart by one letter through the words that remain without it.
_SPELLING_SQL = """with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents),
long as (select coalesce(doc_id::varchar, '') as doc, run, count(*) as n from runs where length(run) >= 7 group by all),
steps as (select list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as step),
hashed as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc || ':' || run, ''),
    lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, ord(c)::bigint - 64] end))), lambda c, b: xor(step[xor(c & 255, b) + 1], c >> 8))) as h from long, steps),
edited as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from edited where length(word) >= 7 group by all having sum(n) >= 2),
cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words)),
near as (select a.word, b.word as other, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by all),
formed as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= 10 * w.n then b.other end as form, case when b.other_n >= 10 * w.n then b.other_n end as form_n
  from words w left join best b using (word)),
follow as (select word, word as root, form as further, 0 as steps from formed
  union all select f.word, f.further, g.form, f.steps + 1 from follow f join formed g on f.further = g.word)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join (select word, last(root order by steps) as root from follow group by all) r using (word)"""
SQL["op12_spelling_groups"] = _SPELLING_SQL


@query
def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.group_variants(table(spark, sf_dir, "documents"))


@query
def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_examples(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
