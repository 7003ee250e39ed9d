"""Secret scans over a ledger of blobs: every text is addressed by its content, scanned once per rule version, and joined back."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import stage, staged_path

#: The base rules, in the order in which they are listed. (kind, pattern, group that is measured, least length of it).
BASE_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further rules of this library.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"
FINDING = "struct<start: int, kind_no: int, end: int, kind: string>"


#: Matches that are placed together. An array that grows by one match is copied each time, so it grows in arrays of this many.
TOGETHER = 256


def _step(no: int, kind: str, least: int):
    """One match after another: where it starts and ends, and whether it counts."""

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["whole"])
        one = F.array(F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(pair["measured"]) >= least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return step


def _places(pairs: Column, no: int, kind: str, least: int) -> Column:
    """The findings among the matches of one rule, placed by TOGETHER at a time: work is in proportion to their number."""
    none = F.expr(f"cast(array() as array<{FINDING}>)")
    nothing = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{FINDING}>>)").alias("parts"))

    def all_of(known: Column) -> Column:
        def part(state: Column, first: Column) -> Column:
            done = F.aggregate(F.slice(known, first, F.lit(TOGETHER)), F.struct(state["at"].alias("at"), none.alias("out")), _step(no, kind, least))
            return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(state["parts"], F.array(d["out"])).alias("parts")))[0]

        starts = F.sequence(F.lit(1), F.greatest(F.size(known), F.lit(1)), F.lit(TOGETHER))
        return F.aggregate(starts, nothing, part, lambda s: F.flatten(s["parts"]))

    # A name for the matches: an expression would be computed anew for each part.
    return F.transform(F.array(pairs), all_of)[0]


def matches(text: Column, rules=RULES) -> Column:
    """All findings of a text, by start and then kind, in code points with the end exclusive.

    SQL functions give the matches of a pattern but not their places; the pieces between them, which a split by the same pattern
    gives, have the rest of the lengths.
    """
    none = F.expr(f"cast(array() as array<{FINDING}>)")
    found = []
    for no, (kind, pattern, group, least) in enumerate(rules):
        p = F.lit(pattern)
        whole = F.regexp_extract_all(text, p, F.lit(0))
        measured = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
        between = F.split(text, pattern, -1)
        pairs = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"), measured.alias("measured"))
        found.append(F.when(F.rlike(text, p), _places(pairs, no, kind, least)).otherwise(none))
    return F.array_sort(F.concat(*found))


def rule_version(rules=RULES, version: str = RULE_VERSION) -> str:
    """The version that findings are entered under: other rules are another version, whatever they are called."""
    return f"{version}-{hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]}"


def _ledger(spark: SparkSession, path: str | None, version: str) -> DataFrame | None:
    """What the ledger holds for a rule version, or nothing if there is no ledger yet."""
    if path is None:
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).where(F.col("rule_version") == version).select("sha", "findings")


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES, version: str = RULE_VERSION, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Every row of docs with `keep`, the content address `sha` and all `findings` of its whole text.

    Each distinct text that the ledger has not seen under this rule version is scanned once and entered; the findings are then joined
    to every row with that text. `ledger` is a folder of Parquet files that grows with every call, so a run over all historical
    versions scans only what is new; without one, the ledger lasts for this call. Null texts count as empty and have no findings.
    Repeated rows each get a row, hot texts are scanned once, an empty table enters nothing. Only `keep` and the text are read. A blob
    that two runs have entered at the same time counts once.
    """
    spark = docs.sparkSession
    version = rule_version(rules, version)
    path = ledger or staged_path(spark)
    rows = docs.select(*keep, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"))
    blobs = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = _ledger(spark, ledger, version)
    if held is not None:
        blobs = blobs.join(held.select("sha"), "sha", "left_anti")
    unseen = blobs.groupBy("sha").agg(F.first("text").alias("text"))
    scanned = unseen.select("sha", F.lit(version).alias("rule_version"), matches(F.col("text"), rules).alias("findings"))
    scanned.write.mode("append").parquet(path)
    found = spark.read.parquet(path).where((F.col("rule_version") == version) & (F.size("findings") > 0)).groupBy("sha").agg(F.first("findings").alias("findings"))
    out = rows.join(found, "sha", "left")
    return out.withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as array<{FINDING}>)")))
