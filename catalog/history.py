"""History store: baselines, prior verdicts, reconciliation, cache, registry, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import features as A, history as H
from packetloom.sources.schema import FEATURES_BASELINE

from .base import Catalog, packets, rd, rdd, table
from .features import W

C = Catalog()

# Derived columns, in SQL that both engines read.
_P = "cast(floor(o_totalprice) as bigint)"
_FEAT = {c: f"cast({_P} % {97 + 31 * i} as double)" for i, c in enumerate(FEATURES_BASELINE)}
_FE = ["o_orderkey as session_id", "concat('c', cast(o_custkey as string)) as ip", *[f"{e} as {c}" for c, e in _FEAT.items()],
       "case when o_orderkey % 13 = 0 then 1 else 0 end as self_telemetry"]
_SE = ["o_orderkey as id", "case when o_orderkey % 7 = 0 then 'test' else 'prod' end as kind",
       "case when o_orderstatus = 'P' then 'failed' else 'done' end as status",
       "case when o_orderkey % 11 = 0 then null else o_orderdate end as finished_at"]
NOW = "timestamp '1998-09-01 00:00:00'"


def _q(e):
    return e.replace(" as count", ' as "count"')


BASE = ("with ipf as (select " + ", ".join(map(_q, _FE)) + " from orders), ses as (select " + ", ".join(_SE) + " from orders)"
        + f""", good as (select ipf.* from ipf join ses on ses.id = session_id where kind = 'prod' and status = 'done' and (finished_at is null or finished_at >= {NOW} - interval 2000 day) and self_telemetry = 0),
  bl as (select ip, n, feature, mean, std from (select ip, count(*) as n, """
        + ", ".join(f"{rdd(f'avg({chr(34)}{c}{chr(34)})', 4)} as m_{c}, {rdd(f'stddev_pop({chr(34)}{c}{chr(34)})', 4)} as s_{c}" for c in FEATURES_BASELINE)
        + " from good group by ip having count(*) >= 2), lateral (values " + ", ".join(f"('{c}', m_{c}, s_{c})" for c in FEATURES_BASELINE) + ") v(feature, mean, std)) ")


def _features(spark, d):
    return table(spark, d, "orders").selectExpr(*_FE)


def _sessions(spark, d):
    return table(spark, d, "orders").selectExpr(*_SE)


def _now(text=NOW):
    return F.expr(text.replace("timestamp '", "timestamp_ntz '"))


def _baselines(spark, d):
    return H.device_baselines(_features(spark, d), _sessions(spark, d), _now(), days=2000)


@C.add("a22_device_baselines", BASE + f"""select ip as device_key, n, feature, {rd('mean')} as mean, {rd('std')} as std, strftime({NOW} - interval 2000 day, '%Y-%m-%d') as window_start from bl""")
def _(spark, d):
    return _baselines(spark, d).select("device_key", "n", "feature", "mean", "std", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"))


_DEV = BASE + ", lf as (unpivot ipf on " + ", ".join(f'"{c}"' for c in FEATURES_BASELINE) + f""" into name feature value "value"), dv as (select session_id, lf.ip, lf.feature, "value", mean as baseline_mean, ("value" - mean) / std as z
  from lf join bl on bl.ip = lf.ip and bl.feature = lf.feature where std > 1e-9 and self_telemetry = 0 and abs(("value" - mean) / std) >= 2.5) """


@C.add("m11_baseline_deviations", _DEV + f"select session_id, ip, feature, \"value\", {rd('baseline_mean')} as baseline_mean, {rdd('z', 2)} as z from dv")
def _(spark, d):
    return H.baseline_deviations(_features(spark, d), _baselines(spark, d), z=2.5)


@C.add("m11_baseline_findings", _DEV + "select session_id, 'baseline' as layer, 'deviation:' || feature as rule, ip, 'medium' as severity from dv")
def _(spark, d):
    return H.baseline_findings(H.baseline_deviations(_features(spark, d), _baselines(spark, d), z=2.5)).drop("detail_json")


_VD = "case o_custkey % 4 when 0 then 'malicious' when 1 then 'benign' when 2 then 'suspicious' else case when o_orderkey % 2 = 0 then 'benign' else 'error' end end"


@C.add("j14_baseline_history", "with ses as (select " + ", ".join(_SE) + f""" from orders), v as (select concat('c', o_custkey) as ip, {_VD} as verdict, finished_at from orders join ses on id = o_orderkey where status = 'done' and o_orderkey <> 7),
  g as (select ip, min(finished_at) as f, count(*) filter (verdict = 'benign') as b, count(*) filter (verdict = 'suspicious') as s, count(*) filter (verdict = 'malicious') as m, count(*) filter (finished_at is null) as nn from v group by ip)
  select ip, true as seen_before, case when nn > 0 then null else cast(floor((epoch_us({NOW}) - epoch_us(f)) / 86400000000.0) as bigint) end as days_since_first_seen,
  nullif(concat_ws(' · ', case when b > 0 then b || '/' || (b + s + m) || ' benign' end, case when s > 0 then s || '/' || (b + s + m) || ' suspicious' end, case when m > 0 then m || '/' || (b + s + m) || ' malicious' end), '') as prior_verdict_summary from g""")
def _(spark, d):
    o = table(spark, d, "orders")
    v = o.selectExpr("o_orderkey as session_id", "1 as candidate_row", f"{_VD} as verdict")
    c = o.selectExpr("o_orderkey as session_id", "1 as candidate_row", "concat('c', o_custkey) as candidate_id")
    return H.baseline_history(v, c, _sessions(spark, d), _now(), session_id=7)


# ---- telemetry --------------------------------------------------------------------------------

_INFRA = ("198.100.0.9", "198.100.1.9", "198.100.4.9", "8.8.8.8")
TEL = W + """, fl as (select session_id, ip_src as src, ip_dst as dst, count(*) as packets from packets where ip_src is not null and ip_dst is not null group by all),
  sp as (select session_id, min(ts) as t0, max(ts) as t1 from packets group by all), tlog as (select event_id as id, epoch_us(ts) / 1e6::double as started_at, epoch_us(ts) / 1e6::double + value as ended_at,
  '198.100.' || (user_id % 6) || '.9' as dst, cast(floor(value) as bigint) as bytes_sent from events where event_type = 'purchase' and user_id % 6 <> 1),
  hit as (select * from fl where dst in ('198.100.0.9', '198.100.1.9', '198.100.4.9', '8.8.8.8')), decl as (select distinct hit.session_id, hit.dst, id from (select distinct session_id, dst from hit) hit join sp using (session_id) join tlog on tlog.dst = hit.dst
  and started_at <= t1 + 120 and ended_at >= t0 - 120), tm as (select hit.*, (session_id, dst) in (select (session_id, dst) from decl) as declared from hit) """


def _tel(spark, d):
    p = packets(spark, d)
    pairs = A.traffic_totals(p).where("dimension = 'pair'").select("session_id", F.col("key").alias("src"), F.col("key2").alias("dst"), "packets")
    spans = p.groupBy("session_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    log = table(spark, d, "events").where("event_type = 'purchase' and user_id % 6 <> 1").select(
        F.col("event_id").alias("id"), start.alias("started_at"), (start + F.col("value")).alias("ended_at"),
        F.expr("concat('198.100.', user_id % 6, '.9')").alias("dst"), F.floor("value").alias("bytes_sent"),
        F.lit(None).cast("string").alias("matched_session_id"))
    infra = spark.createDataFrame([(i,) for i in _INFRA], "dst string")
    return pairs, spans, log, infra


@C.add("j10_telemetry_match", TEL + "select * from tm")
def _(spark, d):
    return H.telemetry_match(*_tel(spark, d))


@C.add("j11_undeclared_flows", TEL + """, dd as (select session_id, '"' || string_agg(distinct dst, '","' order by dst) || '"' as l from tlog join sp on started_at <= t1 + 120 and ended_at >= t0 - 120 group by all)
  select session_id, 'telemetry' as layer, 'undeclared_infra_flow' as rule, src as ip, 'high' as severity, '{"dst":"' || dst || '","packets":' || packets || ',"declared_dsts":[' || coalesce(l, '') || ']}' as detail_json from tm left join dd using (session_id) where not declared""")
def _(spark, d):
    flows, spans, log, infra = _tel(spark, d)
    return H.undeclared_flows(H.telemetry_match(flows, spans, log, infra), spans, log)


@C.add("j12_capture_blind_spots", TEL + """select session_id, 'telemetry' as layer, 'capture_blind_spot' as rule, null::varchar as ip, 'medium' as severity, id as log_id, dst, bytes_sent from tlog join sp on started_at <= t1 + 120 and ended_at >= t0 - 120
  where (session_id, dst) not in (select (session_id, dst) from hit)""")
def _(spark, d):
    return H.capture_blind_spots(*_tel(spark, d))


@C.add("j13_mark_self_telemetry", TEL + """, f as (select distinct session_id, ip_src as ip from packets where ip_src is not null and ip_dst is not null)
  select session_id, ip, ((session_id, ip) in (select (session_id, src) from tm where declared))::bigint as self_telemetry from f""")
def _(spark, d):
    f = A.ip_features(packets(spark, d)).select("session_id", "ip", F.lit(0).alias("self_telemetry"))
    return H.mark_self_telemetry(f, H.telemetry_match(*_tel(spark, d)))


@C.add("j13_claim_log_rows", TEL + "select id, dst, (select min(session_id) from decl where decl.id = tlog.id) as matched_session_id from tlog")
def _(spark, d):
    pairs, spans, log, infra = _tel(spark, d)
    return H.claim_log_rows(log, pairs, spans, infra).select("id", "dst", "matched_session_id")


# ---- cache, registry, retention ---------------------------------------------------------------

@C.add("j15_enrichment_lookup", """with k as (select case c_custkey % 2 when 0 then 'shodan' else 'wigle' end as source, c_name as key, c_custkey as n from customer),
  c as (select source, key, '{"n": ' || n || '}' as data_json, (n % 9 <> 0)::bigint as ok, timestamp '2024-01-31 12:00:00' - to_days(cast(n % 45 as int)) - to_hours(cast(n % 24 as int)) as updated_at from k where n % 4 <> 3)
  select k.source, k.key, data_json, ok, c.key is not null as hit from k left join (select * from c where floor((epoch_us(timestamp '2024-01-31 12:00:00') - epoch_us(updated_at)) / 86400000000.0) <= case source when 'shodan' then 7 else 30 end) c on c.source = k.source and c.key = k.key""")
def _(spark, d):
    k = table(spark, d, "customer").selectExpr("case c_custkey % 2 when 0 then 'shodan' else 'wigle' end as source", "c_name as key", "c_custkey as n")
    now = F.expr("timestamp_ntz '2024-01-31 12:00:00'")
    c = k.where("n % 4 <> 3").selectExpr("source", "key", "concat('{\"n\": ', n, '}') as data_json", "case when n % 9 <> 0 then 1 else 0 end as ok",
                                         "timestamp_ntz '2024-01-31 12:00:00' - make_dt_interval(cast(n % 45 as int), cast(n % 24 as int)) as updated_at")
    return H.enrichment_lookup(k.select("source", "key"), c, now, {"shodan": 7, "wigle": 30})


_NEW = ["sha256(concat('f', cast(doc_id * 2 % 900 as string))) as sha256", "concat('n', cast(doc_id as string)) as orig_name", "n_chars as size_bytes",
        "doc_id as received_at", "concat('/new/', cast(doc_id as string)) as storage_path"]
_REG = ["sha256(concat('f', cast(doc_id as string))) as sha256", "concat('o', cast(doc_id as string)) as orig_name", "n_chars as size_bytes",
        "0 as received_at", "concat('/old/', cast(doc_id as string)) as storage_path", "case when doc_id % 2 = 0 then 'gone' end as deleted_at"]


@C.add("s09_register_captures", "with n as (select " + ", ".join(_NEW) + " from documents), r as (select " + ", ".join(_REG) + """ from documents where doc_id % 3 = 0),
  b as (select * from n qualify row_number() over (partition by sha256 order by received_at, orig_name) = 1)
  select coalesce(r.sha256, b.sha256) as sha256, coalesce(r.orig_name, b.orig_name) as orig_name, case when r.sha256 is null or (b.sha256 is not null and deleted_at is not null) then b.size_bytes else r.size_bytes end as size_bytes,
  case when r.sha256 is null or (b.sha256 is not null and deleted_at is not null) then b.received_at else r.received_at end as received_at, case when r.sha256 is null or (b.sha256 is not null and deleted_at is not null) then b.storage_path else r.storage_path end as storage_path,
  case when r.sha256 is not null and b.sha256 is null then deleted_at end as deleted_at, r.sha256 is null or (b.sha256 is not null and deleted_at is not null) as created from r full join b on r.sha256 = b.sha256""")
def _(spark, d):
    docs = table(spark, d, "documents")
    sha = lambda xs: [x.replace("sha256(concat", "sha2(concat").replace(")) as sha256", "), 256) as sha256") for x in xs]
    return H.register_captures(docs.selectExpr(*sha(_NEW)), docs.where("doc_id % 3 = 0").selectExpr(*sha(_REG)))


_CAP = ["o_orderkey as id", "o_orderdate as received_at", f"{_P} as size_bytes", "case when o_orderkey % 5 = 0 then o_orderdate end as deleted_at",
        "case when o_orderkey % 7 = 0 then null else 'idx' end as fields_path"]


@C.add("r01_expired", "with c as (select " + ", ".join(_CAP) + f" from orders) select id, size_bytes, case when fields_path is null then 'skip' else 'purge' end as action from c where deleted_at is null and received_at < {NOW} - interval 1000 day")
def _(spark, d):
    return H.expired(table(spark, d, "orders").selectExpr(*_CAP), _now(), days=1000).select("id", "size_bytes", "action")


@C.add("r02_w07_over_watermark", "with c as (select " + ", ".join(_CAP) + """ from orders), f as (select id, size_bytes, coalesce(sum(size_bytes) over (order by received_at, id rows between unbounded preceding and 1 preceding), 0) as freed_before from c where deleted_at is null and fields_path is not null)
  select id, size_bytes, cast(freed_before as bigint) as freed_before from f where freed_before < 95000000.0 - 100000000.0 * 0.85""")
def _(spark, d):
    return H.over_watermark(table(spark, d, "orders").selectExpr(*_CAP), 95e6, 100e6).select("id", "size_bytes", "freed_before")


@C.add("r03_capture_gaps", """with e as (select user_id % 10 as sensor_id, event_id as chunk, event_id % 11 as m, ts as started_at, ts + to_milliseconds(cast(floor(value * 1000) as bigint)) as ended_at from events),
  r as (select *, (epoch_us(started_at) - epoch_us(lag(ended_at) over (partition by sensor_id order by started_at, chunk))) / 1e6::double as gap_s from e where m <> 0)
  select sensor_id, chunk, case when chunk % 2 = 0 then 'spool_overflow' else 'missing' end as reason, null::double as gap_s from e where m = 0 union all select sensor_id, chunk, 'silence', round(gap_s, 6) from r where gap_s > 3600""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id % 10 as sensor_id", "event_id as chunk", "event_id % 11 as m", "ts as started_at",
                                             "ts + make_dt_interval(0, 0, 0, cast(floor(value * 1000) / 1000 as decimal(18, 6))) as ended_at",
                                             "case when event_id % 2 = 0 then 'spool_overflow' end as reason")
    return H.capture_gaps(e, e.where("m <> 0"), tolerance_s=3600)
