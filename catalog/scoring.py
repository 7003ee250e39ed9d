"""Statistical and learned scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import correlation as R, features as A, scoring as M
from packetloom.session import cut_lineage
from packetloom.sources.schema import FEATURES_MODEL, FEATURES_PROFILE

from .base import FLOWS_SQL, Catalog, flows, packets, private_sql, rd, rdd, stored
from .features import W, WF, WLAN_SQL

C = Catalog()
FF = f"with {FLOWS_SQL} "


def _feat(spark, d):
    return stored(spark, d, "flow_features", lambda: A.ip_features(flows(spark, d)))


def _std_sql(cols, dev="stddev_pop", src="flow_features", where="true"):
    z = ", ".join(f'("{c}" - avg("{c}") over w) / case when {dev}("{c}") over w = 0 then 1.0 else {dev}("{c}") over w end as "{c}"' for c in cols)
    return f"select session_id, ip, {z} from {src} where {where} window w as (partition by session_id)"


def _cols(cols):
    return ", ".join(f'{rd(chr(34) + c + chr(34))} as "{c}"' for c in cols)


STD_SQL = FF + f", xs as ({_std_sql(FEATURES_MODEL)}) "


@C.add("m01_standardize", STD_SQL + f"select session_id, ip, {_cols(FEATURES_MODEL)} from xs")
def _(spark, d):
    return M.standardize(_feat(spark, d))


@C.add("m02_isolation_forest")
def _(spark, d):
    return M.isolation_forest(_feat(spark, d)).select("session_id", "ip", "iso_score", "iso_flag", "anomaly", "iso_stability")


@C.add("m03_contamination_sweep")
def _(spark, d):
    return M.contamination_sweep(M.isolation_scores(_feat(spark, d), trees=100))


_D2 = " + ".join(f'(a."{c}" - b."{c}") * (a."{c}" - b."{c}")' for c in FEATURES_MODEL)
PAIR_SQL = STD_SQL + f""", dist as (select a.session_id, a.ip as a, b.ip as b, sqrt({_D2}) as dd from xs a join xs b on a.session_id = b.session_id and a.ip <> b.ip),
  near as (select session_id, a as ip, min(dd) as d, row_number() over (partition by session_id order by min(dd) desc, a) as i from dist group by session_id, a),
  bend as (select *, lead(d, 1) over w as k1, lead(d, 2) over w - 2 * lead(d, 1) over w + d as bend from near window w as (partition by session_id order by i)),
  eps as (select session_id, count(*) as n_points, case when {rdd("arg_min(k1, (round(bend, 9), i)) filter (bend is not null)", 2)} <= 0 then greatest({rdd('avg(d)', 3)}, 0.05) else {rdd("arg_min(k1, (round(bend, 9), i)) filter (bend is not null)", 2)} end as eps from bend group by session_id)"""
PAIR_SQL = PAIR_SQL.replace("with flows", "with recursive flows", 1)
CLU_SQL = PAIR_SQL + """, adj as (select session_id, a, b from dist join eps using (session_id) where dd <= eps),
  reach as (select distinct session_id, a as ip, a as root from adj union select r.session_id, adj.b, r.root from reach r join adj on adj.session_id = r.session_id and adj.a = r.ip),
  comp as (select session_id, ip, min(root) as root from reach group by all), num as (select session_id, ip, dense_rank() over (partition by session_id order by root) - 1 as cluster from comp),
  clu as (select xs.session_id, xs.ip, coalesce(cluster, -1) as cluster from xs left join num using (session_id, ip))"""


def _eps(spark, d):
    x = stored(spark, d, "flow_standardized", lambda: M.standardize(_feat(spark, d)))
    return x, stored(spark, d, "flow_eps", lambda: M.knn_elbow_eps(x))


def _clusters(spark, d):
    x, eps = _eps(spark, d)
    return x, stored(spark, d, "flow_clusters", lambda: M.dbscan(x, eps))


@C.add("m04_knn_elbow_eps", PAIR_SQL + " select * from eps")
def _(spark, d):
    return M.knn_elbow_eps(M.standardize(_feat(spark, d)))


@C.add("m05_dbscan", CLU_SQL + " select * from clu")
def _(spark, d):
    x, eps = _eps(spark, d)
    return M.dbscan(x, eps)


@C.add("m05_silhouette", CLU_SQL + f""", mm as (select dist.session_id, a, p.cluster as own, q.cluster as other, avg(dd) as m from dist join clu p on p.session_id = dist.session_id and p.ip = a join clu q on q.session_id = dist.session_id and q.ip = b
  where p.cluster >= 0 and q.cluster >= 0 group by all), pt as (select session_id, a, max(m) filter (own = other) as i, min(m) filter (own <> other) as o from mm group by all),
  sl as (select session_id, avg((o - i) / greatest(o, i)) as s from pt group by all)
  select session_id, count(distinct cluster) filter (cluster >= 0) as n_clusters, count(*) filter (cluster = -1) as n_noise, case when count(distinct cluster) filter (cluster >= 0) >= 2 then {rd('any_value(s)')} end as silhouette
  from clu left join sl using (session_id) group by session_id""")
def _(spark, d):
    return M.silhouette(*_clusters(spark, d))


@C.add("a21_model_agreement_matrix", CLU_SQL + """, ag as (select f.session_id, f.ip, "count" % 5 = 0 as anomaly, cluster = -1 as noise from flow_features f join clu using (session_id, ip))
  select session_id, anomaly, noise, count(*) as n, array_to_string(list_sort(list(ip))[1:3], ';') as examples from ag group by all""")
def _(spark, d):
    f = _feat(spark, d).select("session_id", "ip", (F.col("count") % 5 == 0).alias("anomaly"))
    return M.model_agreement_matrix(f.join(_clusters(spark, d)[1], ["session_id", "ip"]))


_ACT = W + """, tl as (select session_id, ts, ip_src as src from packets where ip_src is not null and ip_dst is not null), z as (select session_id, min(ts) as t0 from tl group by all),
  ac as (select session_id, src, cast(floor((ts - t0) / 21600) as bigint) as bin, count(*)::double as n from tl join z using (session_id) group by all),
  nb as (select session_id, count(distinct bin) as nb from ac group by all having count(distinct bin) >= 2 and count(distinct src) >= 3),
  tp as (select session_id, src, sum(n) / any_value(nb) as mean, sqrt(greatest(sum(n * n) / any_value(nb) - (sum(n) / any_value(nb)) * (sum(n) / any_value(nb)), 0)) as sd, any_value(nb) as nb from ac join nb using (session_id) group by session_id, src
    qualify row_number() over (partition by session_id order by sum(n) desc, src) <= 30),
  xy as (select a.session_id, a.src as a, b.src as b, sum(a.n * b.n) as sxy from ac a join ac b on a.session_id = b.session_id and a.bin = b.bin and a.src < b.src group by all),
  pr as (select a.session_id, a.src as a_src, b.src as b_src, greatest(-1.0, least(1.0, (coalesce(sxy, 0.0) / a.nb - a.mean * b.mean) / ((a.sd + 1e-9::double) * (b.sd + 1e-9::double)))) as c0,
    array_to_string(string_split(a.src, '.')[1:3], '.') = array_to_string(string_split(b.src, '.')[1:3], '.') as same
    from tp a join tp b on a.session_id = b.session_id and a.src < b.src left join xy on xy.session_id = a.session_id and xy.a = a.src and xy.b = b.src),
  co as (select session_id, a_src, b_src, case when same then least(1.0, c0 + 0.25) else c0 end as corr from pr) """


def _pairs(spark, d):
    return M.activity_correlation(packets(spark, d), bin_s=21600)


@C.add("m06_j20_activity_correlation", _ACT + f"select session_id, a_src, b_src, {rd('corr')} as corr, {rd('greatest(0.0, least(2.0, 1 - corr))')} as distance from co")
def _(spark, d):
    return _pairs(spark, d)


@C.add("m06_activity_buckets", _ACT + f""", e as (select session_id, a_src as ip, corr from co union all select session_id, b_src, corr from co), m as (select session_id, ip, avg(corr) as mc from e group by all)
  select session_id, ip, {rd('mc')} as mean_corr, case when mc > 0.6 then 'Tight cluster (same room)' when mc > 0.3 then 'Loose cluster (adjacent)' when mc > 0 then 'Isolated talker' else 'Anti-correlated' end as bucket from m""")
def _(spark, d):
    return M.activity_buckets(_pairs(spark, d))


def _all_pairs_sql(bin_s, least):
    """Every pair of sources that share a bin, without a limit on talkers."""
    return W + f""", tl as (select session_id, ts, ip_src as src from packets where ip_src is not null and ip_dst is not null), z as (select session_id, min(ts) as t0 from tl group by all),
  ac as (select session_id, src, cast(floor((ts - t0) / {bin_s}) as bigint) as bin, count(*)::double as n from tl join z using (session_id) group by all),
  nb as (select session_id, count(distinct bin) as nb from ac group by all having count(distinct bin) >= 2 and count(distinct src) >= 3),
  st as (select session_id, src, any_value(nb) as nb, sum(n) / any_value(nb) as mean, sqrt(greatest(sum(n * n) / any_value(nb) - (sum(n) / any_value(nb)) * (sum(n) / any_value(nb)), 0)) as sd from ac join nb using (session_id) group by session_id, src),
  xy as (select a.session_id, a.src as a, b.src as b, sum(a.n * b.n) as sxy from ac a join ac b on a.session_id = b.session_id and a.bin = b.bin and a.src < b.src group by all),
  pr as (select xy.session_id, a as a_src, b as b_src, greatest(-1.0, least(1.0, (sxy / x.nb - x.mean * y.mean) / ((x.sd + 1e-9::double) * (y.sd + 1e-9::double)))) as c0,
    array_to_string(string_split(a, '.')[1:3], '.') = array_to_string(string_split(b, '.')[1:3], '.') as same
    from xy join st x on x.session_id = xy.session_id and x.src = a join st y on y.session_id = xy.session_id and y.src = b),
  co as (select session_id, a_src, b_src, case when same then least(1.0, c0 + 0.25) else c0 end as corr from pr)
  select session_id, a_src, b_src, {rd('corr')} as corr, {rd('greatest(0.0, least(2.0, 1 - corr))')} as distance from co where corr >= {least}"""


@C.add("m06_all_source_correlation", _all_pairs_sql(30.0, 0.3))
def _(spark, d):
    return R.correlated_sources(packets(spark, d))


@C.add("m06_all_source_correlation_hourly", _all_pairs_sql(3600.0, 0.4))
def _(spark, d):
    return R.correlated_sources(packets(spark, d), bin_s=3600.0, min_corr=0.4)


@C.add("m07_behaviour_projection")
def _(spark, d):
    return M.behaviour_projection(_feat(spark, d))


@C.add("m08_rate_anomaly")
def _(spark, d):
    return M.rate_anomaly(packets(spark, d), bin_s=60)


@C.add("m08_rate_anomaly_1s")
def _(spark, d):
    found = M.rate_anomaly(packets(spark, d))
    return found.groupBy("session_id", "short", F.floor(F.col("bin") / 3600).alias("hour")).agg(
        F.count(F.lit(1)).alias("bins"), F.count_if("flagged").alias("flagged"), F.max("error").alias("worst"), F.max("threshold").alias("threshold"))


@C.add("b06_error_histogram_1s")
def _(spark, d):
    return M.error_histogram(M.rate_anomaly(packets(spark, d)))


@C.add("b06_error_histogram")
def _(spark, d):
    return M.error_histogram(M.rate_anomaly(packets(spark, d), bin_s=60))


Z_SQL = WF + f", z as ({_std_sql(FEATURES_PROFILE, 'stddev_samp', 'features', private_sql('ip'))}) "


@C.add("m09_local_zscores", Z_SQL + f"select session_id, ip, {_cols(FEATURES_PROFILE)} from z")
def _(spark, d):
    return M.local_zscores(A.ip_features(packets(spark, d)))


@C.add("m09_zscore_flags", Z_SQL + f"""select session_id, ip, feature, {rd('z')} as z, case when abs(z) > 3 then 'EXTREME' when abs(z) > 2 then 'HIGH' when z > 1 then 'above' else 'normal' end as flag
  from (unpivot z on {', '.join(chr(34) + c + chr(34) for c in FEATURES_PROFILE)} into name feature value z)""")
def _(spark, d):
    return M.zscore_flags(M.local_zscores(A.ip_features(packets(spark, d))))


@C.add("m10_profile_percentiles", Z_SQL + f""", l as (select session_id, ip, feature, z from (unpivot z on {', '.join(chr(34) + c + chr(34) for c in M.PROFILE_VIEW)} into name feature value z)),
  t as (select session_id, arg_max(ip, (total_bytes, ip)) as ip from z group by all), q as (select session_id, feature, quantile_cont(z, 0.25) as p25, quantile_cont(z, 0.75) as p75 from l group by all)
  select session_id, ip, feature, {rd('z')} as z, {rd('p25')} as p25, {rd('p75')} as p75 from l join t using (session_id, ip) join q using (session_id, feature)""")
def _(spark, d):
    return M.profile_percentiles(M.local_zscores(A.ip_features(packets(spark, d))))


@C.add("m13_rssi_proximity", WLAN_SQL + f""", m as (select session_id, mac, rssi_samples, mean_rssi, std_rssi, greatest(0.1, pow(10.0, (-20.0 - mean_rssi) / 25.0)) as dm from wlan where rssi_samples > 0)
  select session_id, mac, rssi_samples, {rd('mean_rssi')} as mean_rssi, {rd('std_rssi')} as std_rssi, {rd('dm')} as distance_m, case when dm < 2 then 'Same desk (< 2m)' when dm < 5 then 'Same room (2-5m)' when dm < 15 then 'Adjacent room (5-15m)' else 'Far / different floor (> 15m)' end as bucket from m""")
def _(spark, d):
    return M.rssi_proximity(A.wlan_features(packets(spark, d))).select("session_id", "mac", "rssi_samples", "mean_rssi", "std_rssi", "distance_m", "bucket")


@C.add("m14_model_diagnostics")
def _(spark, d):
    # Each model result is a stored table of the session, so it is cut here before the report joins them.
    p = packets(spark, d)
    f = cut_lineage(A.ip_features(p))
    x = cut_lineage(M.standardize(f))
    eps = cut_lineage(M.knn_elbow_eps(x))
    quality = cut_lineage(M.silhouette(x, cut_lineage(M.dbscan(x, eps))))
    return M.model_diagnostics(cut_lineage(M.isolation_forest(f)), eps, quality, cut_lineage(M.rate_anomaly(p, bin_s=60)))
