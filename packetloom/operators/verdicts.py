"""Candidate records, verdict checks, panel resolution, pair comparison and scoring of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_private, is_public, json_path_exists, ti_score, time_context, upload_ratio
from .common import first_per_group, top_per_group
from .features import BY

# The verdict contract and the weights of the ranking.
VERDICTS = ("benign", "suspicious", "malicious")
CATEGORIES = ("beaconing_c2", "dns_tunnel", "dns_amp", "port_scan", "arp_mitm", "syn_flood", "benign_anomaly")
ACTIONS = ("monitor", "investigate", "block")
CATEGORY_WEIGHT = {"syn_flood": 1.0, "dns_amp": 1.0, "arp_mitm": 1.0, "port_scan": 0.8, "beaconing_c2": 0.9,
                   "dns_tunnel": 0.9, "benign_anomaly": 0.0}
W_ANOMALY, W_CONFIDENCE, W_CATEGORY, W_INTEL = 0.20, 0.40, 0.30, 0.10
# Evidence that lets a benign verdict stand against a fired rule: category, path prefix, phrase.
GUARD_ESCAPES = (
    ("dns_amp", "rule_signals.amp_alerts", "public resolver"),
    ("dns_amp", "enrichments.reverse_dns", "public resolver"),
    ("dns_amp", "enrichments.reverse_dns", "anycast"),
    ("dns_amp", "device_context.oui_vendor", "cloud provider"),
)
VERDICT_SCHEMA = ("verdict string, category string, confidence double, evidence_features array<string>, reasoning string, "
                  "recommended_action string")


def severity(verdict: Column) -> Column:
    branch = None
    for i, v in enumerate(VERDICTS):
        branch = F.when(verdict == v, i) if branch is None else branch.when(verdict == v, i)
    return branch


# ---- candidates -------------------------------------------------------------------------------

def detector_reasons(scored: DataFrame, scan: DataFrame, amp: DataFrame, arp: DataFrame, rate_ips: DataFrame | None = None, *,
                     by=BY) -> DataFrame:
    """(ip, reason) of every detector. Density noise counts only in sessions that have a real cluster."""
    tag = lambda df, ip, why: df.select(*by, F.col(ip).alias("ip"), F.lit(why).alias("reason"))
    clustered = scored.where(F.col("cluster") >= 0).select(*by).distinct()
    parts = [tag(scored.where("anomaly"), "ip", "isolation_forest"),
             tag(scored.where(F.col("cluster") == -1).join(clustered, list(by), "left_semi"), "ip", "dbscan_noise"),
             tag(scan, "src", "scan_rule"), tag(amp, "src", "amp_rule"), tag(arp, "ip", "arp_rule")]
    if rate_ips is not None:
        parts.append(tag(rate_ips, "ip", "lstm"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


RULE_REASONS = ("scan_rule", "amp_rule", "arp_rule")


def rank_candidates(reasons: DataFrame, scored: DataFrame, *, by=BY, cap: int = 40) -> DataFrame:
    """One row per flagged address, rules first, then most anomalous. All rows are kept; those beyond ``cap``
    are marked as capped. There are at most six reasons per address."""
    keys = [*by, "ip"]
    rows = reasons.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("reason")), ";").alias("trigger_reasons"),
        F.bool_or(F.col("reason").isin(*RULE_REASONS)).alias("by_rule"))
    rows = rows.join(scored.select(*keys, "iso_score"), keys, "left")
    order = [F.desc("by_rule"), F.asc_nulls_last("iso_score"), F.asc("ip")]
    kept = top_per_group(rows, by, order, cap)
    return rows.join(kept.select(*keys, "rank"), keys, "left").withColumn("capped", F.col("rank").isNull())


# Blocks of a candidate record with their fields; a block that nobody provides is there with NULL fields.
_HOSTS = "array<struct<host: string, count: bigint>>"
_WORST = "struct<score: double, severity: string, count: bigint, peer: string>"
RECORD_BLOCKS = {
    "advanced_signals": (("beaconing", _WORST), ("dns_tunneling", _WORST), ("dga", _WORST), ("tls_anomaly", _WORST),
                         ("fusion_score", "struct<score: double, techniques: int>")),
    "device_context": (("category", "string"), ("hostname", "string"), ("oui_vendor", "string")),
    "websites": (("top_http_hosts", _HOSTS), ("top_tls_sni", _HOSTS), ("top_dns_queries", _HOSTS)),
    "traffic": (("top_dst_ports", "array<struct<port_proto: string, count: bigint>>"), ("bytes_in", "bigint"),
                ("bytes_out", "bigint"), ("upload_ratio", "double")),
    "tls": (("versions", "array<struct<version: string, count: bigint>>"), ("weak_cipher_count", "bigint"),
            ("has_weak_version", "boolean")),
    "baseline_history": (("seen_before", "boolean"), ("days_since_first_seen", "bigint"), ("prior_verdict_summary", "string")),
}


def _block(name: str, has: set[str], prefix: str) -> Column:
    fields = []
    for field, kind in RECORD_BLOCKS[name]:
        value = F.col(prefix + field) if field in has else F.lit(None)
        value = value.cast(kind)
        if field == "upload_ratio" and field not in has and {"bytes_in", "bytes_out"} <= has:
            value = upload_ratio(F.col(f"{prefix}bytes_in"), F.col(f"{prefix}bytes_out"))
        elif (name, field) == ("device_context", "category"):
            value = F.coalesce(value, F.lit("unknown"))
        fields.append(value.alias(field))
    return F.struct(*fields).alias(name)


def assemble_candidates(ranked: DataFrame, scored: DataFrame, scan: DataFrame, amp: DataFrame, arp: DataFrame, flood: DataFrame,
                        summary: DataFrame, parts: dict[str, DataFrame] | None = None, rate_flags: DataFrame | None = None, *,
                        by=BY) -> DataFrame:
    """Nested record per candidate, plus one session candidate where a flood was seen. Candidates beyond the cap
    have no ``rank``; the short list of a report is the records that have one.

    ``parts`` maps a block of ``RECORD_BLOCKS`` to a table keyed by session and ip, or by ip alone, with fields of that block; every
    block is in every record, with NULL fields where nothing is known. ``rate_flags`` has (session, ip, bin_flag_count). Model numbers
    have four digits; a candidate that sent no packets has NULL features and scores."""
    keys = [*by, "ip"]
    alerts = scan.groupBy(*by, F.col("src").alias("ip")).agg(
        F.sort_array(F.collect_list(F.struct("type", "count", "unique_dsts", "ratio"))).alias("scan_alerts"))
    amps = amp.select(*by, F.col("src").alias("ip"), F.array(F.struct("responses", "mean_size")).alias("amp_alerts"))
    claims = arp.select(*keys).distinct().withColumn("arp_multi_mac", F.lit(True))
    model = ("mean_len", "std_len", "count", "burst_score", "unique_dsts", "syn_count", "rst_count", "fin_count", "null_count",
             "xmas_count")
    feats = scored.select(*keys, *[F.round(F.col(c).cast("double"), 4).alias(f"_f_{c}") for c in model],
                          *[F.round(c, 4).alias(c) for c in ("iso_score", "iso_stability")], "anomaly", F.col("cluster").cast("bigint"))
    out = (ranked.drop("iso_score").join(feats, keys, "left").join(alerts, keys, "left").join(amps, keys, "left")
           .join(claims, keys, "left"))
    if rate_flags is None:
        out = out.withColumn("bin_flag_count", F.lit(None).cast("bigint"))
    else:
        out = out.join(rate_flags.select(*keys, "bin_flag_count"), keys, "left")
    no_scan = F.expr("cast(array() as array<struct<type:string,count:bigint,unique_dsts:bigint,ratio:double>>)")
    no_flood = F.expr("cast(array() as array<struct<type:string,total_syn:bigint,syn_sources:bigint,syn_per_sec:double,"
                      "syn_per_source:double,spoofed_source_pattern:boolean>>)")
    no_amp = F.expr("cast(array() as array<struct<responses:bigint,mean_size:double>>)")

    def rules_block(scans, floods, amps, claim):
        return F.struct(F.coalesce(scans, no_scan).alias("scan_alerts"), floods.alias("flood_alerts"),
                        F.coalesce(amps, no_amp).alias("amp_alerts"), F.coalesce(claim, F.lit(False)).alias("arp_multi_mac")).alias("rule_signals")

    def models_block(*values):
        return F.struct(*[v.cast(t).alias(n) for v, (n, t) in zip(values, (
            ("iso_score", "double"), ("iso_stability", "double"), ("anomaly", "boolean"), ("cluster", "bigint"), ("silhouette", "double"),
            ("lstm_bin_flag_count", "bigint")))]).alias("ml_signals")

    def enrichments(private):
        unknown = F.lit(None).cast("string")
        return F.struct(private.cast("boolean").alias("is_private"), unknown.alias("reverse_dns"), unknown.alias("asn"),
                        F.lit(None).cast("boolean").alias("baseline_seen_before")).alias("enrichments")

    none = F.lit(None)
    blocks = []
    for name in RECORD_BLOCKS:
        table = (parts or {}).get(name)
        fields = set() if table is None else set(table.columns)
        if table is not None:
            on = [k for k in keys if k in fields]
            out = out.join(table.select(*on, *[F.col(c).alias(f"_{name}_{c}") for c in table.columns if c not in on]), on, "left")
        blocks.append(_block(name, fields - set(keys), f"_{name}_"))
    # Repeats for candidates that are no address.
    empty = [F.struct(*[(F.lit("unknown") if f == "category" else F.lit(None).cast(t)).alias(f) for f, t in fields]).alias(name)
             for name, fields in RECORD_BLOCKS.items()]
    context = summary.select(*by, F.struct(
        F.round("duration_s", 1).alias("duration_s"), F.col("n_pkts").alias("total_packets"), F.col("n_src_ips").alias("total_ips"), "t0",
        *[time_context(F.col("t0"))[c].alias(c) for c in ("iso_timestamp", "hour_of_day", "day_of_week")]).alias("session_context"))
    features = F.struct(*[F.col(f"_f_{c}").alias(c) for c in model]).alias("features")
    out = out.join(context, list(by), "left").select(
        *by, F.col("ip").alias("candidate_id"), F.lit("ip").alias("kind"), "rank", "session_context", features,
        models_block(F.col("iso_score"), F.col("iso_stability"), F.col("anomaly"), F.col("cluster"), none, F.col("bin_flag_count")),
        rules_block(F.col("scan_alerts"), no_flood, F.col("amp_alerts"), F.col("arp_multi_mac")), *blocks,
        enrichments(is_private(F.col("ip"))), F.split("trigger_reasons", ";").alias("trigger_reasons"))
    seen = F.struct("type", "total_syn", "syn_sources", "syn_per_sec", "syn_per_source", "spoofed_source_pattern")
    flood_row = flood.join(context, list(by), "left").select(
        *by, F.concat(F.lit("session:"), F.col(by[0])).alias("candidate_id"), F.lit("session").alias("kind"), "session_context",
        models_block(*[none] * 6), rules_block(no_scan, F.array(seen), no_amp, F.lit(False)), *empty, enrichments(none),
        F.struct("total_syn", "syn_sources", "syn_per_sec", "syn_per_source", "spoofed_source_pattern").alias("flood"),
        F.array(F.lit("flood_rule")).alias("trigger_reasons"))
    return out.unionByName(flood_row, allowMissingColumns=True)


def evidence_projection(c: DataFrame) -> DataFrame:
    """Compact slice of the wide candidate table for reports. Arrays hold at most five entries each."""
    hosts = F.concat(*[F.coalesce(F.transform(F.col(f"websites.{b}"), lambda x: x["host"]), F.array().cast("array<string>"))
                       for b in ("top_tls_sni", "top_http_hosts", "top_dns_queries")])
    weak = F.coalesce(F.col("tls.has_weak_version"), F.lit(False)) | (F.coalesce(F.col("tls.weak_cipher_count"), F.lit(0)) > 0)
    sites = F.slice(F.array_distinct(hosts), 1, 3)
    return c.select(
        *[k for k in BY if k in c.columns], "candidate_id",
        F.col("device_context.hostname").alias("hostname"), F.col("device_context.oui_vendor").alias("vendor"),
        F.col("device_context.category").alias("category"), "trigger_reasons",
        F.col("features.count").cast("bigint").alias("packets"), F.col("features.unique_dsts").cast("bigint").alias("unique_dsts"),
        F.col("features.syn_count").cast("bigint").alias("syn_count"), F.col("traffic.bytes_out").alias("bytes_out"),
        F.col("traffic.bytes_in").alias("bytes_in"), F.col("ml_signals.iso_score").alias("iso_score"),
        F.slice(F.col("traffic.top_dst_ports"), 1, 3).alias("top_dst_ports"), F.when(F.size(sites) > 0, sites).alias("top_sites"),
        F.when(weak, True).alias("tls_weak"))


# ---- verdict checks ---------------------------------------------------------------------------

def validate_verdict(raw: DataFrame, *, text: str = "verdict_json", max_evidence: int = 12, max_reasoning: int = 400) -> DataFrame:
    """Parse verdict texts. ``reject_reason`` is NULL for valid ones, which carry the normalised fields."""
    doc = F.try_parse_json(F.col(text))
    has = lambda k: F.try_variant_get(doc, F.lit(f"$.{k}"), "variant").isNotNull()
    keys = ("verdict", "category", "confidence", "evidence_features", "reasoning", "recommended_action")
    v = F.from_json(F.col(text), VERDICT_SCHEMA)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(doc, F.lit(f"$.{k}"), "variant"))
    numeric = kind("confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT)")
    out = raw.withColumn("_v", v)
    conf = F.col("_v.confidence")
    squeezed = F.trim(F.regexp_replace(F.col("_v.reasoning"), r"\s+", " "))
    reason = (F.when(doc.isNull() | ~F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), "not an object")
              .when(_any_not([has(k) for k in keys]), "missing fields")
              .when(~F.coalesce(F.col("_v.verdict").isin(*VERDICTS), F.lit(False)), "bad verdict")
              .when(~F.coalesce(F.col("_v.category").isin(*CATEGORIES), F.lit(False)), "bad category")
              .when(~F.coalesce(F.col("_v.recommended_action").isin(*ACTIONS), F.lit(False)), "bad recommended_action")
              .when(~F.coalesce(numeric & conf.between(0.0, 1.0), F.lit(False)), "confidence outside [0, 1]")
              .when(~F.coalesce(kind("evidence_features").startswith("ARRAY"), F.lit(False)), "evidence_features is not a list")
              .when(~F.coalesce((kind("reasoning") == "STRING") & (squeezed != ""), F.lit(False)), "reasoning is empty"))
    out = out.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    return out.select(*raw.columns, "reject_reason", *[F.when(ok, e).alias(n) for n, e in (
        ("verdict", F.col("_v.verdict")), ("category", F.col("_v.category")), ("confidence", F.round(conf, 3)),
        ("evidence_features", F.slice(F.col("_v.evidence_features"), 1, max_evidence)),
        ("reasoning", F.substring(squeezed, 1, max_reasoning)), ("recommended_action", F.col("_v.recommended_action")))])


def _any_not(tests) -> Column:
    out = ~tests[0]
    for t in tests[1:]:
        out = out | ~t
    return out


def verdict_semantics(v: DataFrame) -> DataFrame:
    """Corrects a scan verdict without any scan evidence and an unsure malicious one; notes say what changed.
    Needs scan_fired, flag_mass and unique_dsts beside the verdict columns."""
    no_scan = ((F.col("category") == "port_scan") & ~F.coalesce(F.col("scan_fired"), F.lit(False))
               & (F.coalesce(F.col("flag_mass"), F.lit(0)) < 5) & F.coalesce(F.col("unique_dsts") == 1, F.lit(False)))
    milder = F.when(no_scan & (F.col("verdict") == "malicious"), "suspicious").otherwise(F.col("verdict"))
    unsure = (milder == "malicious") & F.coalesce(F.col("confidence") < 0.5, F.lit(False))
    notes = F.array_compact(F.array(F.when(no_scan, "port_scan_without_flags_or_rule"), F.when(unsure, "confidence_floor_downgrade")))
    return v.withColumns({"notes": notes, "category": F.when(no_scan, "benign_anomaly").otherwise(F.col("category")),
                          "verdict": F.when(unsure, "suspicious").otherwise(milder)})


def evidence_check(v: DataFrame, *, candidate: str = "candidate_json", cited: str = "evidence_features") -> DataFrame:
    """Which cited paths do not exist in the candidate record."""
    missing = F.filter(F.col(cited), lambda path: path.isNotNull() & ~F.coalesce(json_path_exists(F.col(candidate), path), F.lit(False)))
    invalid = F.coalesce(missing, F.expr("cast(array() as array<string>)"))
    return v.withColumns({"evidence_invalid_features": invalid, "evidence_valid": F.size(invalid) == 0})


def rule_expected_category(flood: Column, arp: Column, amp: Column, scan: Column) -> Column:
    return F.when(flood, "syn_flood").when(arp, "arp_mitm").when(amp, "dns_amp").when(scan, "port_scan")


def rule_guardrail(v: DataFrame, *, allow_escape: bool = True, min_escape_confidence: float = 0.85) -> DataFrame:
    """Raises a benign verdict on a candidate whose rule fired, unless whitelisted evidence is cited.
    Needs expected_category beside the verdict columns."""
    expected = F.col("expected_category")
    against = expected.isNotNull() & (F.col("verdict") == "benign")
    text = F.lower(F.coalesce(F.col("reasoning"), F.lit("")))
    escape = F.lit(False)
    for category, prefix, phrase in GUARD_ESCAPES:
        escape = escape | ((expected == category) & F.exists("evidence_features", lambda p: p.startswith(prefix)) & text.contains(phrase))
    bypass = against & F.lit(allow_escape) & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_escape_confidence) & F.coalesce(escape, F.lit(False))
    apply = against & ~bypass
    cites = F.array_join("evidence_features", " ").contains("rule_signals")
    told = F.concat(F.lit("[rule guardrail] The deterministic "), expected, F.lit(
        " rule fired for this candidate, so a benign verdict is not allowed. Model said: "), F.col("reasoning"))
    out = v.withColumns({"_apply": F.coalesce(apply, F.lit(False)), "guardrail_bypassed": F.coalesce(bypass, F.lit(False)),
                         "model_verdict": F.col("verdict"), "model_category": F.col("category")})
    on = F.col("_apply")
    return out.withColumns({
        "evidence_features": F.when(on & ~cites, F.slice(F.concat(F.array(F.lit("rule_signals")), "evidence_features"), 1, 12))
        .otherwise(F.col("evidence_features")),
        "reasoning": F.when(on, F.substring(told, 1, 400)).otherwise(F.col("reasoning")),
        "verdict": F.when(on, "suspicious").otherwise(F.col("verdict")),
        "category": F.when(on, expected).otherwise(F.col("category")),
        "confidence": F.when(on, F.greatest(F.col("confidence"), F.lit(0.6))).otherwise(F.col("confidence")),
        "recommended_action": F.when(on, "investigate").otherwise(F.col("recommended_action")),
        "guardrail_applied": on}).drop("_apply")


def priority_score(v: DataFrame, *, by=BY) -> DataFrame:
    """Rank value from anomaly, confidence, category and intelligence; the anomaly is scaled inside the session."""
    bounds = v.groupBy(*by).agg(F.min("iso_score").alias("_lo"), F.max("iso_score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    norm = F.when(F.col("iso_score").isNotNull() & (span > 0), (F.col("_hi") - F.col("iso_score")) / span).otherwise(0.0)
    weight = None
    for c, w in CATEGORY_WEIGHT.items():
        weight = F.when(F.col("category") == c, w) if weight is None else weight.when(F.col("category") == c, w)
    total = (W_ANOMALY * norm + W_CONFIDENCE * F.col("confidence") + W_CATEGORY * weight
             + W_INTEL * F.coalesce(F.col("ti_score"), F.lit(0.0)))
    return v.join(bounds, list(by)).withColumn("priority", F.round(total, 4)).drop("_lo", "_hi")


def worst_peer_reputation(candidates: DataFrame, pairs: DataFrame, intel: DataFrame, *, by=BY, peers: int = 5) -> DataFrame:
    """Highest reputation score among the busiest public peers of each candidate; only scores above 0."""
    keys = [*by, "ip"]
    public = pairs.where(is_public(F.col("dst"))).select(*by, F.col("src").alias("ip"), F.col("dst").alias("peer"), "packets")
    mine = public.join(candidates.select(*keys).distinct(), keys, "left_semi")
    top = top_per_group(mine, keys, [F.desc("packets"), F.asc("peer")], peers)
    scores = intel.select(F.col("ip").alias("peer"), ti_score(F.col("vulns"), F.col("tags"), F.col("ports")).alias("score"))
    return top.join(scores, "peer").where(F.col("score") > 0).groupBy(*keys).agg(
        F.max("score").alias("ti_score"), F.min_by("peer", F.struct(-F.col("score"), F.col("rank"))).alias("peer"))


# ---- committees and panels --------------------------------------------------------------------

def committee(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Two judges per candidate: the surer of two equal verdicts, the more severe of two different ones."""
    keys = list(keys)
    body = ("verdict", "category", "confidence")
    pack = lambda df, n: df.where("verdict is not null").select(*keys, F.struct(*body).alias(n))
    everyone = a.select(*keys).union(b.select(*keys)).distinct()
    j = everyone.join(pack(a, "a"), keys, "left").join(pack(b, "b"), keys, "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = F.col("a.verdict") == F.col("b.verdict")
    first = F.when(same, F.col("a.confidence") >= F.col("b.confidence")).otherwise(
        severity(F.col("a.verdict")) >= severity(F.col("b.verdict")))
    pick = F.when(both, F.when(first, F.col("a")).otherwise(F.col("b"))).otherwise(F.coalesce("a", "b"))
    note = (F.when(both & same, F.lit(None)).when(both, "judges disagree; using the more severe verdict")
            .when(F.col("a").isNotNull(), "only judge A returned a valid verdict")
            .when(F.col("b").isNotNull(), "only judge B returned a valid verdict").otherwise("both judges failed"))
    return j.withColumns({"_p": pick, "agreement": F.coalesce(both & same, F.lit(False))}).select(
        *keys, "_p.*", "agreement", (~F.col("agreement")).alias("needs_human_review"), note.alias("note"))


def panel_resolve(votes: DataFrame, keys, *, quorum: str = "majority") -> DataFrame:
    """One row per candidate from the votes of a panel (a NULL verdict is a failed judge; ``seat`` orders judges).

    Only counts and best votes per label leave the grouping, so a panel of any size is one partial aggregate."""
    keys = list(keys)
    order = F.struct("confidence", -F.col("seat"))
    body = F.struct("verdict", "category", "confidence", "model")
    valid = F.col("verdict").isNotNull()
    g = votes.groupBy(*keys).agg(
        F.count_if(valid).alias("n_valid"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS],
        F.min(F.when(valid, F.col("category"))).alias("_c0"), F.max(F.when(valid, F.col("category"))).alias("_c1"),
        F.max_by(F.when(valid, body), F.when(valid, order)).alias("_best"),
        *[F.max_by(F.when(F.col("verdict") == v, body), F.when(F.col("verdict") == v, order)).alias(f"_best_{v}") for v in VERDICTS])
    labels = sum((F.when(F.col(f"n_{v}") > 0, 1).otherwise(0) for v in VERDICTS), F.lit(0))
    one_label, one_cat = labels == 1, F.col("_c0") == F.col("_c1")
    n = F.col("n_valid")
    majority = F.lit(None)
    for v in VERDICTS:
        majority = F.coalesce(majority, F.when(F.col(f"n_{v}") * 2 > n, v))
    majority = majority if quorum == "majority" else F.lit(None).cast("string")
    worst = F.coalesce(*[F.when(F.col(f"n_{v}") > 0, v) for v in reversed(VERDICTS)])
    won = F.coalesce(majority, worst)
    eff = F.when(one_label, F.col("_best")).otherwise(_pick(won))
    top_n = F.greatest(*[F.col(f"n_{v}") for v in VERDICTS])
    agreed = one_label & one_cat & (n > 1)
    by_majority = ~one_label & majority.isNotNull() & (n > 1)
    note = (F.when(n == 0, "every panel judge failed").when(n == 1, "only one panel judge returned a valid verdict")
            .when(agreed, F.lit(None)).when(one_label, "judges agree on the verdict but dispute the category")
            .when(by_majority, F.concat(F.lit("panel resolved by majority ("), top_n.cast("string"), F.lit("/"), n.cast("string"),
                                        F.lit(" chose '"), majority, F.lit("')")))
            .otherwise("judges disagree after debate; using the more severe verdict"))
    return g.withColumn("_e", eff).select(
        *keys, "n_valid", "_e.*", F.coalesce(agreed, F.lit(False)).alias("agreement"),
        (~F.coalesce(agreed | by_majority, F.lit(False))).alias("needs_human_review"), note.alias("note"))


def _pick(label: Column) -> Column:
    branch = None
    for v in VERDICTS:
        branch = F.when(label == v, F.col(f"_best_{v}")) if branch is None else branch.when(label == v, F.col(f"_best_{v}"))
    return branch


def panel_disagrees(votes: DataFrame, keys) -> DataFrame:
    """Whether the valid votes differ in label or category."""
    valid = votes.where("verdict is not null")
    return valid.groupBy(*keys).agg(((F.min("verdict") != F.max("verdict")) | (F.min("category") != F.max("category"))).alias("disagrees"))


def votes_summary(votes: DataFrame, resolved: DataFrame, keys) -> DataFrame:
    """One phrase per candidate on how the panel arrived at its verdict."""
    revised = votes.where("verdict is not null").groupBy(*keys).agg(F.bool_or("revised").alias("_revised"))
    n = F.col("n_valid")
    text = n.cast("string")
    phrase = (F.when(n == 0, "-").when(n == 1, "1 judge").when(F.col("needs_human_review"), F.concat(text, F.lit(" split")))
              .when(F.col("_revised"), F.concat(text, F.lit(" agreed in debate")))
              .otherwise(F.concat(text, F.lit("/"), text, F.lit(" unanimous"))))
    return resolved.join(revised, list(keys), "left").select(*keys, "n_valid", phrase.alias("votes"))


def panel_health(votes: DataFrame, resolved: DataFrame, keys) -> DataFrame:
    """Participation of each judging model."""
    final = resolved.select(*keys, F.col("verdict").alias("_final"))
    valid = F.col("verdict").isNotNull()
    g = votes.join(final, list(keys), "left").groupBy("model").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("failures"),
        F.count_if(F.col("cached")).alias("cache_hits"), F.count_if(F.col("revised")).alias("revised"),
        F.count_if(valid & (F.col("verdict") == F.col("_final"))).alias("agreed_with_final"), F.sum("latency_ms").alias("_ms"))
    calls = F.col("valid") + F.col("failures")
    return g.withColumns({"mean_latency_ms": F.when(calls > 0, F.floor(F.col("_ms") / calls)),
                          "degraded": F.col("valid") < F.col("assigned") / 2}).drop("_ms")


def panel_audit_rows(votes: DataFrame, resolved: DataFrame, health: DataFrame, keys) -> DataFrame:
    """Audit table: one row per vote and one summary row per model under candidate '*'."""
    rows = votes.join(resolved.select(*keys, "needs_human_review"), list(keys), "left").select(
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("candidate_id"), F.col("model").alias("judge_model"),
        F.col("initial_verdict"), F.col("verdict").alias("final_verdict"), F.col("revised").cast("int").alias("revised"),
        F.coalesce(F.col("needs_human_review").cast("int"), F.lit(0)).alias("needs_review"), F.substring("error", 1, 500).alias("error"))
    totals = health.select(
        F.lit("*").alias("candidate_id"), F.col("model").alias("judge_model"),
        F.to_json(F.struct("agreed_with_final", "assigned", "failures", "valid")).alias("initial_verdict"),
        F.lit(None).cast("string").alias("final_verdict"), F.col("revised").cast("int").alias("revised"), F.lit(0).alias("needs_review"),
        F.lit(None).cast("string").alias("error"))
    return rows.unionByName(totals)


def vote_matrix(votes: DataFrame, keys, models) -> DataFrame:
    """Candidates by judges; each cell shows the final verdict and confidence, and the first one when revised."""
    short = F.substring("verdict", 1, 3)
    conf = F.coalesce(F.format_string(" %.2f", F.col("confidence")), F.lit(""))
    cell = (F.when(F.col("verdict").isNull(), "_failed_")
            .when(F.col("revised") & (F.col("initial_verdict") != F.col("verdict")),
                  F.concat(F.substring("initial_verdict", 1, 3), F.lit("→"), short, conf, F.lit(" ↺")))
            .otherwise(F.concat(short, conf)))
    return votes.withColumn("_cell", cell).groupBy(*keys).pivot("model", list(models)).agg(F.min("_cell"))


def failure_causes(errors: DataFrame, *, text: str = "error") -> DataFrame:
    """Short causes of provider errors."""
    e = F.col(text)
    low = F.lower(e)
    found = F.array_compact(F.array(
        F.when(e.contains("tokens per minute") | e.contains("(TPM)"), "rate throttle (TPM)"),
        F.when(e.contains("tokens per day") | e.contains("(TPD)") | low.contains("quota"), "daily quota"),
        F.when(e.contains("json_validate_failed") | e.contains("json_schema"), "JSON format unsupported"),
        F.when(low.contains("timeout") | low.contains("timed out"), "timeout")))
    other = F.array(F.substring(F.split(e, " - ")[0], 1, 60))
    return errors.withColumn("causes", F.when(F.size(found) > 0, found).otherwise(other))


def cache_split(candidates: DataFrame, cache: DataFrame, *, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(reused, to judge): candidates with and without a stored verdict."""
    return candidates.join(cache, key), candidates.join(cache, key, "left_anti")


def verdict_counts(v: DataFrame, *, by=BY) -> DataFrame:
    return v.groupBy(*by).agg(*[F.count_if(F.col("verdict") == x).alias(x) for x in reversed(VERDICTS)])


def quota_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider", F.to_date("called_at").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.max(F.when(F.col("was_429"), F.col("called_at"))).alias("last_429_at"))


def is_exhausted(usage: DataFrame, *, request_cap: int | None = None, token_cap: int | None = None) -> DataFrame:
    hit = F.lit(not (request_cap or token_cap))
    if request_cap:
        hit = hit | (F.col("requests") >= request_cap)
    if token_cap:
        hit = hit | (F.col("tokens") >= token_cap)
    return usage.withColumn("exhausted", F.col("last_429_at").isNotNull() & hit)


# ---- pair comparison --------------------------------------------------------------------------

def verdict_pair_diff(v1: DataFrame, v2: DataFrame, *, key: str = "ip", carry: tuple[str, ...] = ()) -> DataFrame:
    """Full outer comparison of the verdicts of two sessions, one row per address, all kept. ``carry`` names further columns of both
    sides to take along."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{c}_{p}") for c in ("verdict", "category", "confidence", *carry)])
    j = side(v1, "s1").withColumn("_1", F.lit(True)).join(side(v2, "s2").withColumn("_2", F.lit(True)), key, "full")
    change = (F.when(F.col("_2").isNull(), "only_s1").when(F.col("_1").isNull(), "only_s2")
              .when(F.col("verdict_s1") == F.col("verdict_s2"), "unchanged")
              .when(F.col("verdict_s1").isNotNull() & F.col("verdict_s2").isNotNull(), "flip").otherwise("unknown"))
    flow = F.when(change == "flip", F.concat("verdict_s1", F.lit(" -> "), "verdict_s2"))
    return j.withColumns({"change": change, "flow": flow}).drop("_1", "_2")


def device_text(vendor: Column, hostname: Column) -> Column:
    """'vendor hostname' of what is known, NULL if nothing is."""
    return F.nullif(F.concat_ws(" ", F.nullif(vendor, F.lit("")), F.nullif(hostname, F.lit(""))), F.lit(""))


def pair_report(v1: DataFrame, v2: DataFrame, captures: DataFrame | None = None, *, labels: tuple[str, str] = ("S1", "S2"),
                shown: int = 20, worst: int = 3, key: str = "ip") -> DataFrame:
    """One row that sums up how the verdicts of two sessions differ.

    Counts cover all addresses; the lists hold the first ``shown`` addresses of one side only (worst first, then surest, then by
    address) and of those whose verdict changed (by address, with the confidence of both sides), and the ``worst`` surest non-benign
    ones of each side. Inputs need verdict, category, confidence and may have vendor and hostname, one row per address.
    ``captures``, if given, has a row per session as `context_record` makes them (session_id, t0 and what else is to be shown); the
    gap runs from the start of the first capture to that of the second. Without data, counts are 0 and lists empty."""
    named = lambda df: df.withColumn("device", device_text(
        *[F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("vendor", "hostname")]))
    diff = verdict_pair_diff(named(v1), named(v2), key=key, carry=("device",))
    flows = [f"{a} -> {b}" for a in VERDICTS for b in VERDICTS if a != b]
    on = {p: F.col("change") != other for p, other in (("s1", "only_s2"), ("s2", "only_s1"))}
    tally = diff.agg(
        *[F.struct(*[F.count_if(on[p] & (F.col(f"verdict_{p}") == v)).alias(v) for v in reversed(VERDICTS)]).alias(f"counts_{p}") for p in on],
        *[F.count_if(on[p]).alias(f"total_{p}") for p in on],
        *[F.count_if(F.col("change") == c).alias(n) for c, n in (
            ("only_s1", "only_s1_total"), ("only_s2", "only_s2_total"), ("flip", "flip_total"), ("unchanged", "unchanged"))],
        *[F.count_if(F.col("flow") == f).alias(f) for f in flows])
    flow = F.create_map(*[c for f in flows for c in (F.lit(f), F.col(f"`{f}`"))])
    tally = tally.withColumn("category_flow", F.map_filter(flow, lambda _, n: n > 0)).drop(*flows)

    def one(p):
        return F.struct(F.col(key).alias("ip"), *[F.col(f"{c}_{p}").alias(c) for c in ("verdict", "category", "confidence", "device")])

    flip = F.struct(F.col(key).alias("ip"), F.col("verdict_s1").alias("from"), F.col("verdict_s2").alias("to"),
                    F.col("confidence_s1").alias("from_confidence"), F.col("confidence_s2").alias("to_confidence"),
                    F.col("category_s2").alias("s2_category"), F.col("device_s2").alias("device"))
    bad_first = lambda p: [F.desc_nulls_last(severity(F.col(f"verdict_{p}"))), F.desc(F.coalesce(f"confidence_{p}", F.lit(0.0))), F.asc(key)]
    surest = lambda p: [F.desc(F.coalesce(f"confidence_{p}", F.lit(0.0))), F.asc(key)]
    bad = lambda p: F.col(f"verdict_{p}").isin("malicious", "suspicious")
    lists = {
        "only_s1": (diff.where("change = 'only_s1'"), bad_first("s1"), shown, one("s1")),
        "only_s2": (diff.where("change = 'only_s2'"), bad_first("s2"), shown, one("s2")),
        "flips": (diff.where("change = 'flip'"), [F.asc(key)], shown, flip),
        "top_non_benign_s1": (diff.where(on["s1"] & bad("s1")), surest("s1"), worst, one("s1")),
        "top_non_benign_s2": (diff.where(on["s2"] & bad("s2")), surest("s2"), worst, one("s2")),
    }
    out = tally.select(F.lit(labels[0]).alias("s1"), F.lit(labels[1]).alias("s2"), "*")
    for name, (rows, order, n, body) in lists.items():
        # The first rows of a whole ordered table: each task sends n of them.
        head = rows.orderBy(*order).limit(n).select(F.monotonically_increasing_id().alias("_at"), body.alias("_b"))
        out = out.join(head.agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_b"))), lambda s: s["_b"]).alias(name)))
    risky = F.filter("only_s2", lambda r: r["verdict"].isin("malicious", "suspicious"))
    out = out.withColumn("new_non_benign_s2", risky)
    if captures is None:
        return out
    sides = captures.where(F.col("session_id").isin(*labels)).agg(*[
        F.max_by(F.struct("*"), F.when(F.col("session_id") == label, 1)).alias(f"capture_{p}") for label, p in zip(labels, on)])
    return out.join(sides).withColumn("gap_seconds", F.round(F.col("capture_s2.t0") - F.col("capture_s1.t0")).cast("bigint"))


def pair_change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change", "flow").agg(F.count(F.lit(1)).alias("n"))


def pair_highlights(diff: DataFrame, *, shown: int = 20, worst: int = 3, key: str = "ip") -> DataFrame:
    """Short lists of the pair report: addresses of one side only (worst first), flips, top non-benign per side."""
    def ranked(name, rows, p, order, n):
        rows = rows.select(F.lit(name).alias("section"), key, F.col(f"verdict_{p}").alias("verdict"),
                           F.col(f"category_{p}").alias("category"), F.col(f"confidence_{p}").alias("confidence"), "flow")
        return top_per_group(rows, ["section"], order, n)

    bad_first = [F.desc(severity(F.col("verdict"))), F.desc("confidence"), F.asc(key)]
    by_conf = [F.desc("confidence"), F.asc(key)]
    bad = lambda p: F.col(f"verdict_{p}").isin("malicious", "suspicious")
    return (ranked("only_s1", diff.where("change = 'only_s1'"), "s1", bad_first, shown)
            .unionByName(ranked("only_s2", diff.where("change = 'only_s2'"), "s2", bad_first, shown))
            .unionByName(ranked("flips", diff.where("change = 'flip'"), "s2", [F.asc(key)], shown))
            .unionByName(ranked("top_s1", diff.where(bad("s1")), "s1", by_conf, worst))
            .unionByName(ranked("top_s2", diff.where(bad("s2")), "s2", by_conf, worst)))


# Posture changes from mild to severe.
POSTURES = ("stable", "de-escalated", "mixed", "escalated")


def pair_posture_vote(answers: DataFrame, keys) -> DataFrame:
    """Majority posture per pair, the more severe on a tie, with its surest answer."""
    keys = list(keys)
    rank = None
    for i, p in enumerate(POSTURES):
        rank = F.when(F.col("posture") == p, i) if rank is None else rank.when(F.col("posture") == p, i)
    g = answers.groupBy(*keys, "posture").agg(F.count(F.lit(1)).alias("votes"), F.max_by("model", F.struct("confidence", "model")).alias("model"),
                                              F.max("confidence").alias("confidence"))
    total = g.groupBy(*keys).agg(F.sum("votes").alias("answered"))
    return first_per_group(g.withColumn("_rank", rank), keys, [F.desc("votes"), F.desc("_rank")]).drop("_rank").join(total, keys)


def notable_flips(answers: DataFrame, keys, *, n: int = 5) -> DataFrame:
    """Flips listed by the judges of the winning side, once per address with its surest mention."""
    one = first_per_group(answers, [*keys, "ip"], [F.desc("confidence"), F.asc("model")])
    return top_per_group(one, keys, [F.desc("confidence"), F.asc("ip")], n)


# ---- quality ----------------------------------------------------------------------------------

def prf(detected: DataFrame, truth: DataFrame, *, by=BY, key: str = "ip") -> DataFrame:
    """Precision, recall and F1 of two address sets, with the conventions for empty sets."""
    d = detected.select(*by, key).distinct().withColumn("_d", F.lit(1))
    t = truth.select(*by, key).distinct().withColumn("_t", F.lit(1))
    g = d.join(t, [*by, key], "full").groupBy(*by).agg(
        F.count("_d").alias("n_detected"), F.count("_t").alias("n_truth"), F.count_if(F.col("_d").isNotNull() & F.col("_t").isNotNull()).alias("tp"))
    p = F.when(F.col("n_detected") > 0, F.col("tp") / F.col("n_detected")).otherwise(F.when(F.col("n_truth") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("n_truth") > 0, F.col("tp") / F.col("n_truth")).otherwise(1.0)
    return g.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(
        F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def align_truth(results: DataFrame, truth: DataFrame, *, by=BY, flood_category: str = "syn_flood") -> DataFrame:
    """True category beside each judged candidate. In flood sessions only the session candidate counts, in
    others only the addresses; unlisted addresses are benign. ``truth``: session, ip, category, is_flood."""
    floods = truth.where("is_flood").select(*by).distinct().withColumn("_flood", F.lit(True))
    labels = truth.where("ip is not null").select(*by, F.col("ip").alias("candidate_id"), F.col("category").alias("_true")).distinct()
    j = results.join(floods, list(by), "left").join(labels, [*by, "candidate_id"], "left")
    flood = F.coalesce(F.col("_flood"), F.lit(False))
    j = j.where(F.when(flood, F.col("kind") == "session").otherwise(F.col("kind") == "ip"))
    true_cat = F.when(flood, flood_category).otherwise(F.coalesce("_true", F.lit("benign_anomaly")))
    return j.withColumn("true_category", true_cat).withColumn(
        "true_verdict", F.when(F.col("true_category") == "benign_anomaly", "benign").otherwise("malicious")).drop("_flood", "_true")


def confusion(pairs: DataFrame, labels=CATEGORIES, *, true: str = "true_category", pred: str = "category") -> DataFrame:
    """Counts for every pair of labels, zeros included. The label grid is fixed and small."""
    grid = pairs.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], f"{true} string, {pred} string")
    got = pairs.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(got, [true, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_label_prf(pairs: DataFrame, labels=CATEGORIES, *, true: str = "true_category", pred: str = "category") -> DataFrame:
    """Precision, recall, F1 and support per label that occurs; empty denominators give 0."""
    ends = pairs.select(F.inline(F.array(
        F.struct(F.col(true).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("hit")),
        F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))))
    g = ends.where(F.col("label").isin(*labels)).groupBy("label").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("tp")).where("support > 0")
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    return g.select("label", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"),
                    F.round(div(2 * F.col("tp"), F.col("predicted") + F.col("support")), 3).alias("f1"), "support")


def cohen_kappa(pairs: DataFrame, labels=CATEGORIES, *, true: str = "true_category", pred: str = "category",
                weights: str | None = None) -> DataFrame:
    """Agreement beyond chance, one row: NULL without data or when undefined, 1 when all agree."""
    at = lambda c: F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)) - 1
    k = len(labels)
    cells = pairs.groupBy(at(true).alias("i"), at(pred).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    # At most k x k counted cells: one array of them decides the rest.
    packed = cells.agg(F.sum("n").alias("n"), F.collect_list(F.struct("i", "j", "n")).alias("m"))
    idx = F.sequence(F.lit(0), F.lit(k - 1))
    row = lambda i: F.aggregate("m", F.lit(0.0), lambda a, s: a + F.when(s["i"] == i, s["n"]).otherwise(0))
    col = lambda j: F.aggregate("m", F.lit(0.0), lambda a, s: a + F.when(s["j"] == j, s["n"]).otherwise(0))
    dist = (lambda i, j: F.abs(i - j)) if weights == "linear" else (lambda i, j: F.when(i == j, 0).otherwise(1))
    out = packed.withColumns({"_r": F.transform(idx, row), "_c": F.transform(idx, col)})
    seen = F.aggregate("m", F.lit(0.0), lambda a, s: a + s["n"] * dist(s["i"], s["j"]))
    chance = F.aggregate(F.flatten(F.transform(idx, lambda i: F.transform(idx, lambda j: F.get("_r", i) * F.get("_c", j) * dist(i, j)))),
                         F.lit(0.0), lambda a, v: a + v) / F.col("n")
    kappa = F.when(F.col("n").isNull(), None).when(seen == 0, 1.0).when(chance == 0, None).otherwise(F.round(1 - seen / chance, 4))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), kappa.cast("double").alias("kappa"))


def expectation_checks(observed: DataFrame, expected: DataFrame, *, by=BY) -> DataFrame:
    """Compare observed values per session and check with the expected bound: 'equal', 'at_most' or 'at_least'."""
    j = expected.join(observed, [*by, "check"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    ok = (F.when(F.col("mode") == "equal", F.col("observed") == F.col("bound"))
          .when(F.col("mode") == "at_most", F.col("observed") <= F.col("bound")).otherwise(F.col("observed") >= F.col("bound")))
    return j.withColumn("passed", ok)


def judge_benchmark(rows: DataFrame, *, by=("model",)) -> DataFrame:
    """Quality of a judging model over labelled cases; a dropped case counts as wrong. Needs truth_kind, correct,
    verdict_correct, guardrail_applied, model_verdict, error, latency_ms."""
    attack, benign = F.col("truth_kind") == "attack", F.col("truth_kind") == "benign"
    rate = lambda hit, base: F.when(F.count_if(base) > 0, F.round(F.count_if(base & hit) / F.count_if(base), 3))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fixtures"), F.count("error").alias("dropped"), rate(yes("correct"), F.lit(True)).alias("category_accuracy"),
        rate(yes("verdict_correct"), attack).alias("detection_rate"), rate(yes("verdict_correct"), benign).alias("benign_accuracy"),
        F.count_if(attack & yes("guardrail_applied") & yes("verdict_correct") & (F.col("model_verdict") == "benign")).alias("guardrail_saves"),
        F.floor(F.avg("latency_ms")).alias("latency_ms_mean"), F.floor(F.percentile("latency_ms", 0.5)).alias("latency_ms_median"))
    det, acc = F.col("detection_rate"), F.coalesce(F.col("category_accuracy"), F.lit(0.0))
    word = (F.when((F.col("fixtures") > 0) & (F.col("dropped") * 3 >= F.col("fixtures")), "NOT USABLE")
            .when((det >= 1.0) & (acc >= 0.8), "GOOD").when(det >= 1.0, "ACCEPTABLE").otherwise("WEAK"))
    return g.withColumn("qualification", word)


def locate_access_points(points: DataFrame, places: DataFrame) -> DataFrame:
    """Heard access points with a known position."""
    known = places.where("lat is not null").select(F.lower("bssid").alias("bssid"), "lat", "lon", F.col("ssid").alias("_ssid"))
    return points.withColumn("bssid", F.lower("bssid")).join(known, "bssid").withColumn("ssid", F.coalesce("ssid", "_ssid")).drop("_ssid")
