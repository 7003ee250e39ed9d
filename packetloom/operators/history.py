"""History tables: device baselines, prior verdicts, telemetry reconciliation, enrichment cache, registry,
retention plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import FEATURES_BASELINE
from .common import first_per_group, unpivot

DAY_S = 86_400


# ---- baselines --------------------------------------------------------------------------------

def device_baselines(ip_features: DataFrame, sessions: DataFrame, now: Column, *, days: int = 30, min_sessions: int = 2,
                     columns=FEATURES_BASELINE) -> DataFrame:
    """Mean and population deviation of every feature of a device over its recent production sessions.

    ``now`` is a timestamp column (a literal in practice). One row per device and feature."""
    start = now - F.make_dt_interval(F.lit(days))
    good = sessions.where((F.col("kind") == "prod") & (F.col("status") == "done")
                          & (F.col("finished_at").isNull() | (F.col("finished_at") >= start))).select(F.col("id").alias("session_id"))
    rows = ip_features.where(F.col("self_telemetry") == 0).join(good, "session_id", "left_semi")
    stats = rows.groupBy("ip").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias("mean"),
                   F.round(F.coalesce(F.stddev_pop(c), F.lit(0.0)), 4).alias("std")).alias(c) for c in columns])
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.std").alias("std"))
                              for c in columns]))
    return stats.where(F.col("n") >= min_sessions).select(
        F.col("ip").alias("device_key"), "n", start.alias("window_start"), now.alias("window_end"), long)


def baseline_deviations(ip_features: DataFrame, baselines: DataFrame, *, z: float = 3.0, columns=FEATURES_BASELINE) -> DataFrame:
    """Features of a session that lie far from the device's own history."""
    long = unpivot(ip_features.where(F.col("self_telemetry") == 0), ["session_id", "ip"], columns)
    base = baselines.where(F.col("std") > 1e-9).select(
        F.col("device_key").alias("ip"), "feature", F.col("mean").alias("baseline_mean"), F.col("std").alias("_std"))
    score = (F.col("value") - F.col("baseline_mean")) / F.col("_std")
    return (long.where(F.col("value").isNotNull()).join(base, ["ip", "feature"]).withColumn("_z", score)
            .where(F.abs("_z") >= z).select("session_id", "ip", "feature", "value", "baseline_mean", F.round("_z", 2).alias("z")))


def baseline_findings(deviations: DataFrame) -> DataFrame:
    body = F.to_json(F.struct("baseline_mean", "feature", "ip", "value", "z"))
    return deviations.select("session_id", F.lit("baseline").alias("layer"), F.concat(F.lit("deviation:"), "feature").alias("rule"),
                             "ip", F.lit("medium").alias("severity"), body.alias("detail_json"))


def baseline_history(verdicts: DataFrame, candidates: DataFrame, sessions: DataFrame, now: Column, *,
                     session_id=None) -> DataFrame:
    """Prior verdicts per address over the finished sessions other than ``session_id``."""
    done = sessions.where(F.col("status") == "done").select(F.col("id").alias("session_id"), "finished_at")
    if session_id is not None:
        done = done.where(F.col("session_id") != session_id)
    seen = (verdicts.join(candidates.select("session_id", "candidate_row", "candidate_id"), ["session_id", "candidate_row"])
            .join(done, "session_id"))
    labels = ("benign", "suspicious", "malicious")
    tally = seen.groupBy(F.col("candidate_id").alias("ip")).agg(
        F.min_by("finished_at", F.coalesce(F.unix_micros(F.col("finished_at").cast("timestamp")), F.lit(0))).alias("_first"),
        *[F.count_if(F.col("verdict") == x).alias(x) for x in labels])
    total = F.col(labels[0]) + F.col(labels[1]) + F.col(labels[2])
    part = lambda x: F.when(F.col(x) > 0, F.concat(F.col(x).cast("string"), F.lit("/"), total.cast("string"), F.lit(f" {x}")))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return tally.select("ip", F.lit(True).alias("seen_before"), F.floor(age / (DAY_S * 1_000_000)).alias("days_since_first_seen"),
                        F.nullif(F.concat_ws(" · ", *[part(x) for x in labels]), F.lit("")).alias("prior_verdict_summary"))


# ---- telemetry reconciliation -----------------------------------------------------------------

def _overlapping(flows: DataFrame, spans: DataFrame, log: DataFrame, slack_s: float) -> DataFrame:
    """Pairs (session, dst, log row) with equal destination and overlapping time.

    Both sides are cut into day buckets, so the join is an equality on (dst, day) and one busy destination is
    spread over its days; the exact overlap is tested on the pairs of a bucket."""
    day = lambda c: F.floor(c / DAY_S).cast("bigint")
    wanted = flows.select("session_id", "dst").distinct().join(
        spans.select("session_id", (F.col("t0") - slack_s).alias("_a"), (F.col("t1") + slack_s).alias("_b")), "session_id")
    wanted = wanted.withColumn("_day", F.explode(F.sequence(day(F.col("_a")), day(F.col("_b")))))
    rows = log.where(F.col("dst").isNotNull() & (F.col("ended_at") >= F.col("started_at"))).select(
        "dst", F.col("id").alias("log_id"), "started_at", "ended_at",
        F.explode(F.sequence(day(F.col("started_at")), day(F.col("ended_at")))).alias("_day"))
    return wanted.join(rows, ["dst", "_day"]).where(
        (F.col("started_at") <= F.col("_b")) & (F.col("ended_at") >= F.col("_a"))).select("session_id", "dst", "log_id").distinct()


def telemetry_match(flows: DataFrame, spans: DataFrame, log: DataFrame, infra: DataFrame, *, slack_s: float = 120.0) -> DataFrame:
    """Flows to infrastructure destinations, each declared or not by an overlapping telemetry row.

    ``flows``: session_id, src, dst, packets. ``spans``: session_id, t0, t1. ``infra``: dst."""
    hit = flows.join(infra.select("dst").distinct(), "dst", "left_semi")
    declared = _overlapping(hit, spans, log, slack_s).select("session_id", "dst", F.lit(True).alias("declared")).distinct()
    return hit.join(declared, ["session_id", "dst"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def undeclared_flows(matched: DataFrame, spans: DataFrame, log: DataFrame, *, slack_s: float = 120.0) -> DataFrame:
    """Findings for the flows no telemetry row declares, with the destinations that rows of that time do declare."""
    over = overlapping_rows(spans, log.where(F.col("dst").isNotNull()).select("id", "dst", "started_at", "ended_at"), slack_s=slack_s)
    declared = over.select("session_id", "dst").distinct().groupBy("session_id").agg(F.sort_array(F.collect_list("dst")).alias("declared_dsts"))
    none = F.array().cast("array<string>")
    return matched.where(~F.col("declared")).join(declared, "session_id", "left").select(
        "session_id", F.lit("telemetry").alias("layer"), F.lit("undeclared_infra_flow").alias("rule"), F.col("src").alias("ip"),
        F.lit("high").alias("severity"), F.to_json(F.struct("dst", "packets", F.coalesce("declared_dsts", none).alias("declared_dsts"))).alias("detail_json"))


#: Levels of the time index: a minute, two, four, ... about eleven days.
TIME_LEVELS = 14


def _minute(c):
    return F.floor(c / 60).cast("bigint")


def _holders(c):
    """The time cell of every level that a moment lies in, as one number each."""
    return F.transform(F.sequence(F.lit(0), F.lit(TIME_LEVELS)), lambda j: F.call_function("shiftright", _minute(c), j) * 32 + j)


def _pieces(lo, hi):
    """The fewest time cells that an interval consists of: at most two of a level, and any number of the widest."""
    def level(j):
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), j)
        left, right = F.call_function("shiftright", _minute(lo) + width - 1, j), F.call_function("shiftright", _minute(hi) + 1, j)
        odd = lambda n: F.pmod(n, F.lit(2)) == 1
        return F.array_compact(F.array(F.when((left < right) & odd(left), left * 32 + j), F.when((left < right) & odd(right), (right - 1) * 32 + j)))

    widest = F.lit(TIME_LEVELS)
    width = F.lit(1 << TIME_LEVELS).cast("bigint")
    left, right = F.call_function("shiftright", _minute(lo) + width - 1, widest), F.call_function("shiftright", _minute(hi) + 1, widest)
    top = F.when(left < right, F.transform(F.sequence(left, right - 1), lambda n: n * 32 + TIME_LEVELS)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TIME_LEVELS - 1)), level)), top)


def overlapping_rows(spans: DataFrame, log: DataFrame, *, slack_s: float = 120.0) -> DataFrame:
    """session_id and the columns of the log rows (started_at, ended_at and others) whose time overlaps the session's, each pair once.

    Of two overlapping intervals one starts inside the other. A start lies in one cell of each level and an interval is made of
    disjoint cells, so both cases are equality joins on cells in which a pair meets exactly once."""
    sessions = spans.select("session_id", (F.col("t0") - slack_s).alias("_a"), (F.col("t1") + slack_s).alias("_b")).where("_a <= _b")
    rows = log.where(F.col("ended_at") >= F.col("started_at"))
    columns = ["session_id", *log.columns]
    starts_in = sessions.withColumn("_cell", F.explode(_pieces(F.col("_a"), F.col("_b")))).join(
        rows.withColumn("_cell", F.explode(_holders(F.col("started_at")))), "_cell").where("started_at >= _a and started_at <= _b").select(*columns)
    began_before = rows.withColumn("_cell", F.explode(_pieces(F.col("started_at"), F.col("ended_at")))).join(
        sessions.withColumn("_cell", F.explode(_holders(F.col("_a")))), "_cell").where("started_at < _a and ended_at >= _a").select(*columns)
    return starts_in.unionByName(began_before)


def capture_blind_spots(flows: DataFrame, spans: DataFrame, log: DataFrame, infra: DataFrame, *, slack_s: float = 120.0) -> DataFrame:
    """Telemetry rows that overlap a session but whose destination the session never contacted."""
    over = overlapping_rows(spans, log.select(F.col("id").alias("log_id"), "dst", "bytes_sent", "started_at", "ended_at"), slack_s=slack_s)
    seen = flows.join(infra.select("dst").distinct(), "dst", "left_semi").select("session_id", "dst").distinct()
    return over.join(seen, ["session_id", "dst"], "left_anti").select(
        "session_id", F.lit("telemetry").alias("layer"), F.lit("capture_blind_spot").alias("rule"), F.lit(None).cast("string").alias("ip"),
        F.lit("medium").alias("severity"), "log_id", "dst", "bytes_sent")


def mark_self_telemetry(ip_features: DataFrame, matched: DataFrame) -> DataFrame:
    mine = matched.where("declared").select("session_id", F.col("src").alias("ip"), F.lit(1).alias("_mine")).distinct()
    return ip_features.join(mine, ["session_id", "ip"], "left").withColumn(
        "self_telemetry", F.coalesce("_mine", "self_telemetry", F.lit(0))).drop("_mine")


def claim_log_rows(log: DataFrame, flows: DataFrame, spans: DataFrame, infra: DataFrame, *, slack_s: float = 120.0) -> DataFrame:
    """Telemetry log with the matching session filled in where it is still empty (the first by id)."""
    hit = flows.join(infra.select("dst").distinct(), "dst", "left_semi")
    owner = _overlapping(hit, spans, log, slack_s).groupBy(F.col("log_id").alias("id")).agg(F.min("session_id").alias("_s"))
    return log.join(owner, "id", "left").withColumn(
        "matched_session_id", F.coalesce("matched_session_id", "_s")).drop("_s")


# ---- enrichment, registry ---------------------------------------------------------------------

def enrichment_lookup(keys: DataFrame, cache: DataFrame, now: Column, ttl_days: dict[str, int]) -> DataFrame:
    """Cached record per (source, key) while it is fresh; ``hit`` is false for the keys to fetch again.
    Negative records (ok = 0) are hits without data."""
    ttl = F.element_at(F.create_map(*[x for s, d in ttl_days.items() for x in (F.lit(s), F.lit(d))]), F.col("source"))
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / (DAY_S * 1_000_000))
    fresh = cache.where(age <= ttl).select("source", "key", "data_json", "ok", F.lit(True).alias("hit"))
    return keys.join(fresh, ["source", "key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def register_captures(new: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry after an upload batch, by content hash: new rows are created, purged rows reactivated with the
    new file, others left alone. ``created`` marks the rows to analyse."""
    batch = first_per_group(new, ["sha256"], [F.asc("received_at"), F.asc("orig_name")])
    cols = [c for c in registry.columns if c != "sha256"]
    incoming = batch.select("sha256", F.lit(True).alias("_new"), *[
        (F.col(c) if c in batch.columns else F.lit(None)).alias(f"_n_{c}") for c in cols])
    joined = registry.withColumn("_old", F.lit(True)).join(incoming, "sha256", "full")
    fresh = F.col("_old").isNull()
    back = F.col("_old") & F.coalesce(F.col("_new"), F.lit(False)) & F.col("deleted_at").isNotNull()
    replaced = ("storage_path", "size_bytes", "received_at")
    out = [F.col("sha256")]
    for c in cols:
        if c == "deleted_at":
            out.append(F.when(~fresh & ~back, F.col(c)).alias(c))
        elif c in replaced:
            out.append(F.when(fresh | back, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out, F.coalesce(fresh | back, F.lit(False)).alias("created"))


# ---- retention --------------------------------------------------------------------------------

def expired(captures: DataFrame, now: Column, *, days: int = 7) -> DataFrame:
    """Live captures older than the limit; without a field index they are kept and marked as skipped."""
    old = captures.where(F.col("deleted_at").isNull() & (F.col("received_at") < now - F.make_dt_interval(F.lit(days))))
    return old.withColumn("action", F.when(F.col("fields_path").isNotNull(), "purge").otherwise("skip"))


def over_watermark(captures: DataFrame, used: float, total: float, *, pct: float = 85.0) -> DataFrame:
    """Oldest captures whose removal brings the usage down to ``pct``; captures without an index are skipped.

    The running size is taken over days first (one row per day), then inside each day, so the whole list is
    not ordered in one task."""
    live = captures.where(F.col("deleted_at").isNull() & F.col("fields_path").isNotNull()).withColumn(
        "_day", F.to_date("received_at"))
    days = live.groupBy("_day").agg(F.sum("size_bytes").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("_day").orderBy("received_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    freed = live.join(days.withColumn("_before", before), "_day").withColumn(
        "freed_before", F.col("_before") + F.coalesce(F.sum("size_bytes").over(inside), F.lit(0)))
    need = used - total * pct / 100.0
    return freed.where(F.col("freed_before") < F.lit(float(need))).drop("_day", "_sum", "_before")


def capture_gaps(expected: DataFrame, received: DataFrame, *, tolerance_s: float = 0.0) -> DataFrame:
    """Chunks that were announced or dropped but never received, with the silence before the next one."""
    missing = expected.join(received.select("chunk"), "chunk", "left_anti").select(
        "sensor_id", "chunk", F.coalesce("reason", F.lit("missing")).alias("reason"), F.lit(None).cast("double").alias("gap_s"))
    # A sensor's files are ordered inside their day; the first file of a day follows the last one of the day before.
    at = F.struct("started_at", "chunk")
    rows = received.withColumn("_day", F.to_date("started_at"))
    inner = Window.partitionBy("sensor_id", "_day").orderBy("started_at", "chunk")
    outer = Window.partitionBy("sensor_id").orderBy("_day")
    inside = (rows.withColumn("_prev", F.lag("ended_at").over(inner)).where(F.col("_prev").isNotNull())
              .select("sensor_id", "chunk", "started_at", "_prev"))
    edges = (rows.groupBy("sensor_id", "_day").agg(F.min(at).alias("_f"), F.max_by("ended_at", at).alias("_last"))
             .withColumn("_prev", F.lag("_last").over(outer)).select("sensor_id", "_f.chunk", "_f.started_at", "_prev"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    holes = inside.unionByName(edges).withColumn("gap_s", (micros("started_at") - micros("_prev")) / 1e6).where(
        F.col("gap_s") > tolerance_s).select("sensor_id", "chunk", F.lit("silence").alias("reason"), "gap_s")
    return missing.unionByName(holes)
