"""Statistical and learned scores over the per-host feature table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import behaviour_tags, distance_bucket, is_private, rssi_distance_m, subnet24
from ..session import cut_lineage, staged
from ..sources.schema import FEATURES_MAP, FEATURES_MODEL, FEATURES_PROFILE
from .browsing import lag_sequences, rate_series
from .neighbours import close_components, elbow, nearest_distances, numbered
from .common import quantiles, top_per_group, unpivot
from .features import BY, timeline


def _stats(df: DataFrame, by, cols, deviation) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                               *[deviation(c).alias(f"_s_{c}") for c in cols])


def _scaled(df: DataFrame, by, cols, deviation) -> DataFrame:
    """(x - mean) / deviation per group with 0 taken as 1. The group statistics are one row per group and are
    joined back, so a large group is not ordered or gathered."""
    joined = df.join(_stats(df, by, cols, deviation), list(by))
    out = {}
    for c in cols:
        s = F.col(f"_s_{c}")
        out[c] = (F.col(c) - F.col(f"_m_{c}")) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return joined.withColumns(out).drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def standardize(df: DataFrame, cols: Sequence[str] = FEATURES_MODEL, *, by=BY, key: str = "ip") -> DataFrame:
    filled = df.select(*by, key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return _scaled(filled, by, cols, F.stddev_pop)


def local_zscores(features: DataFrame, cols: Sequence[str] = FEATURES_PROFILE, *, by=BY) -> DataFrame:
    """z-scores among the private hosts, with the sample deviation; NULL when there is one host only."""
    rows = features.where(is_private(F.col("ip"))).select(*by, "ip", *[F.col(c).cast("double").alias(c) for c in cols])
    return _scaled(rows, by, cols, F.stddev_samp)


def zscore_flags(zscores: DataFrame, cols: Sequence[str] = FEATURES_PROFILE, *, by=BY) -> DataFrame:
    z = F.col("z")
    return unpivot(zscores, [*by, "ip"], cols, "feature", "z").withColumn(
        "flag", F.when(F.abs(z) > 3, "EXTREME").when(F.abs(z) > 2, "HIGH").when(z > 1, "above").otherwise("normal"))


PROFILE_VIEW = ("count", "total_bytes", "mean_len", "unique_dsts", "burst_score", "syn_count", "rst_count")


def profile_percentiles(zscores: DataFrame, ip: str | None = None, *, by=BY, cols: Sequence[str] = PROFILE_VIEW) -> DataFrame:
    """Quartiles of each z over the devices next to the z of one device: ``ip``, else the busiest."""
    filled = zscores.select(*by, "ip", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    long = unpivot(filled, [*by, "ip"], cols, "feature", "z")
    spread = quantiles(long, [*by, "feature"], "z", (0.25, 0.75), ("p25", "p75"))
    order = F.struct(F.when(F.col("ip") == ip, 1).otherwise(0) if ip else F.lit(0), F.col("total_bytes"), F.col("ip"))
    target = filled.groupBy(*by).agg(F.max_by("ip", order).alias("ip"))
    return long.join(target, [*by, "ip"], "left_semi").join(spread, [*by, "feature"])


def burst_outlier_tags(features: DataFrame, *, by=BY, anomaly: str = "anomaly") -> DataFrame:
    b = quantiles(features, by, "burst_score", (0.95,), ("_qb",))
    d = quantiles(features, by, "dominance", (0.95,), ("_qd",))
    flag = F.col(anomaly) if anomaly in features.columns else F.lit(False)
    return features.join(b.join(d, list(by)), list(by)).withColumn("tags", behaviour_tags(
        F.col("syn_count"), F.col("rst_count"), F.col("burst_score"), F.col("dominance"), flag, F.col("_qb"), F.col("_qd"))
    ).drop("_qb", "_qd")


# ---- isolation forest -------------------------------------------------------------------------

def _mean_path(n):
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.where(n > 2, n, 3.0)
    return np.where(n > 2, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe, np.where(n == 2, 1.0, 0.0))


_TREE_FIELDS = "feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"


def _grow(x: np.ndarray, rng, limit: int):
    feature, threshold, left, right, path = [], [], [], [], []

    def node(rows, depth):
        at = len(feature)
        for lst, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (path, depth + float(_mean_path(len(rows))))):
            lst.append(v)
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            return at
        f = int(rng.choice(usable))
        t = float(rng.uniform(low[f], high[f]))
        side = rows[:, f] < t
        if not side.any():
            side = rows[:, f] <= low[f]
        feature[at], threshold[at] = f, t
        left[at] = node(rows[side], depth + 1)
        right[at] = node(rows[~side], depth + 1)
        return at

    node(x, 0)
    return feature, threshold, left, right, path


def _walk(x: np.ndarray, feature, threshold, left, right, path) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return path[at]
        here = at[inner]
        go_left = x[inner, feature[here]] < threshold[here]
        at[inner] = np.where(go_left, left[here], right[here])


def isolation_scores(features: DataFrame, cols: Sequence[str] = FEATURES_MODEL, *, by=BY, trees: int = 200,
                     sample: int = 256, seed: int = 42, chunk_rows: int = 50_000) -> DataFrame:
    """Isolation-forest score per host (higher is more ordinary), one forest per session.

    Each host draws its trees by hash, so every tree gets about ``sample`` rows without gathering a session;
    trees are grown in parallel, one small group each; a session is scored in chunks of bounded size."""
    cols, by = list(cols), list(by)
    x = standardize(features, cols, by=by)
    sizes = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = x.join(sizes, by)
    rate = F.least(F.lit(1.0), F.lit(1.3 * sample) / F.col("_n"))
    draw = lambda t: F.shiftrightunsigned(F.xxhash64("ip", t, F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = sized.select(*by, "ip", "_n", *cols, F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < rate)).alias("tree"))
    drawn = drawn.withColumn("_order", F.xxhash64("ip", "tree", F.lit(seed)))
    types = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in by)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "ip"])
        take = pdf.head(sample)
        tree = int(take["tree"].iloc[0])
        limit = int(np.ceil(np.log2(max(min(sample, int(take["_n"].iloc[0])), 2))))
        parts = _grow(take[cols].to_numpy(float), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([[*(take[k].iloc[0] for k in by), tree, *parts]],
                            columns=[*by, "tree", "feature", "threshold", "left", "right", "path"])

    grown = drawn.groupBy(*by, "tree").applyInPandas(grow, f"{key_schema}, tree int, {_TREE_FIELDS}")
    forest = grown.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(
        "tree", "feature", "threshold", "left", "right", "path"))).alias("forest"))
    chunks = F.ceil(F.col("_n") / chunk_rows)
    forest = forest.join(sizes, by).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    rows = sized.withColumn("_chunk", F.pmod(F.xxhash64("ip"), chunks))

    def score(key, hosts: pd.DataFrame, trees_of: pd.DataFrame) -> pd.DataFrame:
        if not len(hosts):
            return pd.DataFrame(columns=[*by, "ip", "score_samples"])
        x = hosts[cols].to_numpy(float)
        total, n = np.zeros(len(x)), 0
        for t in trees_of["forest"].iloc[0]:
            total += _walk(x, *[np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "path")])
            n += 1
        scale = float(_mean_path(min(sample, int(hosts["_n"].iloc[0]))))
        out = hosts[[*by, "ip"]].copy()
        out["score_samples"] = -np.power(2.0, -(total / max(n, 1)) / (scale or 1.0))
        return out

    return rows.groupBy(*by, "_chunk").cogroup(forest.groupBy(*by, "_chunk")).applyInPandas(
        score, f"{key_schema}, ip string, score_samples double")


def isolation_forest(features: DataFrame, cols: Sequence[str] = FEATURES_MODEL, *, by=BY, contamination: float = 0.10,
                     **options) -> DataFrame:
    """Adds iso_score (below 0 is anomalous), iso_flag (-1 or 1), anomaly and iso_stability."""
    scores = isolation_scores(features, cols, by=by, **options)
    offset = quantiles(scores, by, "score_samples", (contamination,), ("_offset",))
    out = scores.join(offset, list(by)).select(*by, "ip", (F.col("score_samples") - F.col("_offset")).alias("iso_score"))
    bad = F.col("iso_score") < 0
    return features.join(out, [*by, "ip"]).withColumns({
        "iso_flag": F.when(bad, -1).otherwise(1), "anomaly": bad, "iso_stability": bad.cast("double")})


def contamination_sweep(scores: DataFrame, *, by=BY, low: float = 0.02, high: float = 0.30, steps: int = 20) -> DataFrame:
    """How many hosts each contamination level flags and their mean score."""
    levels = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    cuts = quantiles(scores, by, "score_samples", levels, [f"_q{i}" for i in range(steps)])
    level = F.inline(F.array(*[F.struct(F.lit(c).alias("contamination"), F.col(f"_q{i}").alias("cut"))
                               for i, c in enumerate(levels)]))
    off = F.col("score_samples") - F.col("cut")
    return (scores.join(cuts, list(by)).select(*by, "score_samples", level).groupBy(*by, "contamination")
            .agg(F.count_if(off < 0).alias("n_flagged"), F.coalesce(F.avg(F.when(off < 0, off)), F.lit(0.0)).alias("mean_score")))


# ---- distances in blocks ----------------------------------------------------------------------

def _key_schema(df: DataFrame, by) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {types[k]}" for k in by)


def knn_elbow_eps(x: DataFrame, cols: Sequence[str] = FEATURES_MODEL, *, by=BY) -> DataFrame:
    """Radius at the sharpest bend of the sorted nearest-neighbour distances; a fixed one below four points, which have no bend."""
    bend = elbow(staged(nearest_distances(x, cols, by=by)), by=by)
    eps = F.when(F.col("n_points") >= 4, F.round("elbow", 2)).otherwise(1.3)
    return bend.select(*by, "n_points", F.when(eps <= 0, F.greatest(F.round("mean", 3), F.lit(0.05))).otherwise(eps).alias("eps"))


def dbscan(x: DataFrame, eps: DataFrame, cols: Sequence[str] = FEATURES_MODEL, *, by=BY) -> DataFrame:
    """Density clusters with two points as minimum: the connected components of the points within eps.

    Returns ip, cluster (numbered by the smallest address in it) and -1 for lonely points."""
    by = list(by)
    found = staged(close_components(x, eps, cols, by=by))
    number = numbered(found.where("size > 1").select(*by, "root").distinct(), "root", by=by, name="cluster")
    return found.join(number, [*by, "root"], "left").select(*by, "ip", F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster"))


def _block_pairs(points: DataFrame, by, block: int) -> DataFrame:
    """Every point once per pair of blocks its block takes part in, so that distances are taken in bounded pieces.

    A small cluster lies in one block, together with others; a cluster of more than ``block`` points has blocks of its own."""
    sizes = points.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("_m"))
    small = F.sum(F.when(F.col("_m") <= block, F.col("_m")).otherwise(0))
    shared = sizes.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(small / block)).alias("_shared"))
    large = F.col("_m") > block
    part = F.when(large, F.pmod(F.xxhash64("ip"), F.ceil(F.col("_m") / block))).otherwise(F.pmod(F.xxhash64("cluster"), F.col("_shared")))
    placed = staged(points.join(sizes, [*by, "cluster"]).join(shared, by).withColumn(
        "_blk", F.concat_ws(":", F.when(large, F.col("cluster").cast("string")).otherwise("small"), part)).drop("_m", "_shared"))
    blocks = placed.select(*by, F.col("_blk").alias("_o")).distinct()
    return placed.join(blocks, by).withColumns({"_bi": F.least("_blk", "_o"), "_bj": F.greatest("_blk", "_o")}).drop("_o")


#: Rows of a block whose distances are held at a time, and squared distances, as a share of the squared lengths, that are taken again.
ROWS_AT_ONCE, NEAR = 100, 1e-6


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances from a matrix product. It loses the digits of near points, so these are taken again by their differences."""
    total = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    d = x @ y.T
    d *= -2.0
    d += total
    total *= NEAR
    i, j = np.nonzero(d <= total)
    for lo in range(0, len(i), 100_000):
        some = slice(lo, lo + 100_000)
        d[i[some], j[some]] = ((x[i[some]] - y[j[some]]) ** 2).sum(axis=1)
    return np.sqrt(d, out=d)


def _own_and_nearest(points: pd.DataFrame, clusters: np.ndarray, total: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """By point the distance sums and sizes of its own cluster and of the nearest other one. A large cluster is alone in its blocks, so
    its sums are partial; all other clusters are whole in a block."""
    own = points["cluster"].to_numpy()[:, None] == clusters[None, :]
    chosen = own.copy()
    chosen[np.arange(len(points)), np.where(own, np.inf, total / sizes).argmin(axis=1)] = True
    i, c = np.nonzero(chosen)
    return points.iloc[i][["ip", "cluster"]].assign(other=clusters[c], total=total[i, c], size=sizes[c])


def _sides(points: pd.DataFrame, cols, centre: np.ndarray) -> tuple:
    clusters, starts = np.unique(points["cluster"].to_numpy(), return_index=True)
    weight = points["n"].to_numpy(float)
    return points[cols].to_numpy(float) - centre, weight, clusters, starts, np.add.reduceat(weight, starts)


def _block_sums(left: pd.DataFrame, right: pd.DataFrame, cols, back: bool) -> pd.DataFrame:
    """Distance sums from the points of one block to the clusters of the other, and back if wanted. Each distance is taken once."""
    left, right = left.sort_values("cluster"), right.sort_values("cluster")
    centre = right[cols].to_numpy(float).mean(axis=0)
    x, mine, own_clusters, _, own_sizes = _sides(left, cols, centre)
    y, weight, clusters, starts, sizes = _sides(right, cols, centre)
    number = np.searchsorted(own_clusters, left["cluster"].to_numpy())
    returned, parts = np.zeros((len(own_clusters), len(right) if back else 0)), []
    for lo in range(0, len(left), ROWS_AT_ONCE):
        some = slice(lo, lo + ROWS_AT_ONCE)
        d = _distances(x[some], y)
        total = (d @ weight)[:, None] if len(clusters) == 1 else np.add.reduceat(d * weight, starts, axis=1)
        parts.append(_own_and_nearest(left.iloc[some], clusters, total, sizes))
        if back:
            of, first = np.unique(number[some], return_index=True)
            if len(of) == 1:
                returned[of[0]] += mine[some] @ d
            else:
                returned[of] += np.add.reduceat(d * mine[some, None], first, axis=0)
    if back:
        parts.append(_own_and_nearest(right, own_clusters, returned.T, own_sizes))
    return pd.concat(parts)


def silhouette(x: DataFrame, clusters: DataFrame, cols: Sequence[str] = FEATURES_MODEL, *, by=BY, block: int = 8_000) -> DataFrame:
    """Clusters, noise and the mean silhouette of the clustered points; NULL with fewer than two clusters.

    Equal points of a cluster are one point with a count. Between different points all distances are needed, so the work grows with
    their square; a task holds two blocks of them and a point leaves a pair of blocks as two rows at most."""
    cols, by = list(cols), list(by)
    rows = x.join(clusters.where("cluster >= 0"), [*by, "ip"])
    points = staged(rows.groupBy(*by, "cluster", *cols).agg(F.min("ip").alias("ip"), F.count(F.lit(1)).alias("n")))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_blk"] == pdf["_bi"]], pdf[pdf["_blk"] == pdf["_bj"]]
        out = _block_sums(a, b, cols, pdf["_bi"].iloc[0] != pdf["_bj"].iloc[0])
        for key in reversed(by):
            out.insert(0, key, pdf[key].iloc[0])
        return out

    met = _block_pairs(points, by, block).groupBy(*by, "_bi", "_bj").applyInPandas(
        sums, f"{_key_schema(x, by)}, ip string, cluster int, other int, total double, size double")
    summed = met.groupBy(*by, "ip", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    own = F.col("other") == F.col("cluster")
    mean = F.col("total") / F.when(~own, F.col("size")).when(F.col("size") > 1, F.col("size") - 1)
    point = summed.groupBy(*by, "ip").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    counted = point.join(points.select(*by, "ip", "n"), [*by, "ip"])
    s = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    judged = counted.withColumn("s", s).where("s is not null")
    score = judged.groupBy(*by).agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("silhouette"))
    counts_ = clusters.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise"))
    return counts_.join(score, by, "left").withColumn(
        "silhouette", F.when(F.col("n_clusters") >= 2, F.col("silhouette")))


def model_agreement_matrix(scored: DataFrame, *, by=BY, shown: int = 3) -> DataFrame:
    """Forest anomaly against density noise: hosts in each of the four cells and the first few of them."""
    rows = scored.select(*by, "ip", F.col("anomaly"), (F.col("cluster") == -1).alias("noise"))
    keys = [*by, "anomaly", "noise"]
    some = top_per_group(rows, keys, [F.asc("ip")], shown, "_r").groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list("ip")), ";").alias("examples"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(some, keys)


# ---- activity and projection ------------------------------------------------------------------

def activity_correlation(packets: DataFrame, *, by=BY, bin_s: float = 30.0, top: int = 30, bonus: float = 0.25) -> DataFrame:
    """How alike the busiest talkers of a session are in time: correlation of their packet counts per bin,
    raised for neighbours of one /24. Pairs exist only among the ``top`` talkers."""
    by = list(by)
    rows = timeline(packets, by=by)
    start = rows.groupBy(*by).agg(F.min("time").alias("_t0"))
    act = rows.join(start, by).groupBy(*by, "src", F.floor((F.col("time") - F.col("_t0")) / bin_s).alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    bins = act.groupBy(*by).agg(F.count_distinct("bin").alias("_bins"), F.count_distinct("src").alias("_srcs")).where(
        (F.col("_bins") >= 2) & (F.col("_srcs") >= 3))
    sums = act.groupBy(*by, "src").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    best = top_per_group(sums, by, [F.desc("s"), F.asc("src")], top).join(bins, by)
    mean = F.col("s") / F.col("_bins")
    best = best.withColumns({"mean": mean, "var": F.col("ss") / F.col("_bins") - mean * mean}).withColumn(
        "sd", F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))).select(*by, "src", "mean", "sd", "var", "_bins")
    busy = act.join(best.select(*by, "src"), [*by, "src"], "left_semi")
    side = lambda df, p, cols: df.select(*by, *[F.col(c).alias(f"{p}{c}") for c in cols])
    cross = (busy.select(*by, "bin", F.col("src").alias("a_src"), F.col("n").alias("a_n")).join(
                 busy.select(*by, "bin", F.col("src").alias("b_src"), F.col("n").alias("b_n")), [*by, "bin"])
             .where("a_src < b_src").groupBy(*by, "a_src", "b_src").agg(F.sum(F.col("a_n") * F.col("b_n")).alias("sxy")))
    stats = ("src", "mean", "sd", "var")
    pairs = (side(best.withColumn("n_bins", F.col("_bins")), "a_", (*stats, "n_bins")).join(side(best, "b_", stats), by)
             .where("a_src < b_src").join(cross, [*by, "a_src", "b_src"], "left"))
    cov = F.coalesce("sxy", F.lit(0.0)) / F.col("a_n_bins") - F.col("a_mean") * F.col("b_mean")
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / ((F.col("a_sd") + 1e-9) * (F.col("b_sd") + 1e-9))))
    same = subnet24(F.col("a_src")) == subnet24(F.col("b_src"))
    pairs = pairs.withColumn("corr", F.when(same, F.least(F.lit(1.0), corr + bonus)).otherwise(corr))
    return pairs.select(*by, "a_src", "b_src", "corr", F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.col("corr"))).alias("distance"))


def activity_buckets(pairs: DataFrame, *, by=BY) -> DataFrame:
    """Mean correlation of each talker with the others, and its bucket."""
    ends = pairs.select(*by, "corr", F.explode(F.array("a_src", "b_src")).alias("ip"))
    m = F.col("mean_corr")
    return ends.groupBy(*by, "ip").agg(F.avg("corr").alias("mean_corr")).withColumn(
        "bucket", F.when(m > 0.6, "Tight cluster (same room)").when(m > 0.3, "Loose cluster (adjacent)")
        .when(m > 0.0, "Isolated talker").otherwise("Anti-correlated"))


def behaviour_projection(features: DataFrame, cols: Sequence[str] = FEATURES_MAP, *, by=BY) -> DataFrame:
    """Two principal components of the standardised features, per session.

    Spark sums the products of the columns; one row per session (a small matrix) is decomposed and joined back."""
    cols, by = list(cols), list(by)
    x = standardize(features, cols, by=by)
    k = len(cols)
    moments = x.groupBy(*by).agg(F.array(*[F.avg(F.col(a) * F.col(b)) for a in cols for b in cols]).alias("m"))

    @F.pandas_udf("array<double>")
    def axes(m: pd.Series) -> pd.Series:
        def one(flat):
            _, vectors = np.linalg.eigh(np.asarray(flat, dtype=float).reshape(k, k))
            main = vectors[:, ::-1][:, :2]
            sign = np.sign(main[np.abs(main).argmax(axis=0), range(main.shape[1])])
            return (main * np.where(sign == 0, 1, sign)).T.ravel().tolist()
        return m.map(one)

    joined = x.join(moments.select(*by, axes("m").alias("v")), by)
    dot = lambda j: sum((F.col(c) * F.col("v")[j * k + i] for i, c in enumerate(cols)), F.lit(0.0))
    return joined.select(*by, "ip", dot(0).alias("pc1"), dot(1).alias("pc2"))


# ---- rate anomaly -----------------------------------------------------------------------------

def rate_anomaly(packets: DataFrame, *, by=BY, lags: int = 10, train_share: float = 0.8, bin_s: float = 1.0,
                 min_bins: int = 20, sigmas: float = 2.0) -> DataFrame:
    """Bins whose mean packet size a linear predictor on the ``lags`` bins before misses by far.

    Spark sums the products of the lags; the normal equations of a session (one row) give its weights. The
    threshold is the mean error of the last fifth plus ``sigmas`` deviations. Sessions under ``min_bins`` bins have no model: their
    bins come back unjudged, with ``short`` set."""
    by = list(by)
    series = cut_lineage(rate_series(packets, by=by, bin_s=bin_s))
    limits = series.groupBy(*by).agg(F.min("mean_size").alias("_lo"), F.max("mean_size").alias("_hi"),
                                     F.count(F.lit(1)).alias("_bins"))
    short = F.col("_bins") < min_bins
    span = F.col("_hi") - F.col("_lo")
    scaled = series.join(limits, by).withColumn(
        "mean_size", (F.col("mean_size") - F.col("_lo")) / F.when(span == 0, F.lit(1.0)).otherwise(span))
    unjudged = scaled.where(short).select(*by, "bin", "second", F.col("mean_size").alias("target"), *[F.lit(None).cast("double").alias(c) for c in ("error", "threshold")],
                                          F.lit(False).alias("flagged"), F.lit(True).alias("short"))
    rows = lag_sequences(scaled.where(~short), by=by, lags=lags)
    train = F.col("bin") - lags < F.floor((F.col("_bins") - lags) * train_share)
    terms = [F.lit(1.0), *[F.col(f"lag_{i}") for i in range(1, lags + 1)]]
    fit = rows.where(train).groupBy(*by).agg(
        F.array(*[F.sum(a * b) for a in terms for b in terms]).alias("xx"),
        F.array(*[F.sum(a * F.col("target")) for a in terms]).alias("xy"))
    k = lags + 1

    @F.pandas_udf("array<double>")
    def weights(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.asarray(a, float).reshape(k, k), np.asarray(b, float), rcond=None)[0].tolist()
                          for a, b in zip(xx, xy)])

    rows = rows.join(fit.select(*by, weights("xx", "xy").alias("w")), by)
    guess = sum((F.col("w")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    rows = rows.withColumns({"error": F.abs(guess - F.col("target")), "is_train": train})
    limit = rows.where(~F.col("is_train")).groupBy(*by).agg(
        (F.avg("error") + sigmas * F.stddev_pop("error")).alias("threshold"))
    return rows.join(limit, by).select(*by, "bin", "second", "target", "error", "threshold",
                                       (F.col("error") > F.col("threshold")).alias("flagged"), F.lit(False).alias("short")).unionByName(unjudged)


def rate_flag_counts(packets: DataFrame, flagged: DataFrame, *, by=BY, bin_s: float = 1.0) -> DataFrame:
    """How many flagged bins each source is answerable for: a flagged bin counts for the source that sent the most bytes in it, the
    smaller address on a tie. ``flagged`` needs the session and ``bin`` as the rate series numbers them.

    Bytes are summed by bin and source before anything is compared, so a busy second is one row per source."""
    by = list(by)
    rows = timeline(packets, by=by)
    start = rows.groupBy(*by).agg(F.min("time").alias("_t0"))
    bins = rows.join(start, by).withColumn("bin", F.floor((F.col("time") - F.col("_t0")) / bin_s))
    sent = (bins.join(flagged.select(*by, "bin").distinct(), [*by, "bin"], "left_semi")
            .groupBy(*by, "bin", "src").agg(F.sum("size").alias("_bytes")))
    top = sent.groupBy(*by, "bin").agg(F.min_by("src", F.struct(-F.col("_bytes"), "src")).alias("ip"))
    return top.groupBy(*by, "ip").agg(F.count(F.lit(1)).alias("bin_flag_count"))


def error_histogram(errors: DataFrame, *, by=BY, bins: int = 60) -> DataFrame:
    """Errors of the judged bins of a session by size."""
    errors = errors.where(F.col("error").isNotNull())
    span = errors.groupBy(*by).agg(F.min("error").alias("_lo"), F.max("error").alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("error") - F.col("_lo")) / width))
    return errors.join(span, list(by)).groupBy(*by, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))


def rssi_proximity(wlan: DataFrame) -> DataFrame:
    heard = wlan.where(F.col("rssi_samples") > 0)
    metres = rssi_distance_m(F.col("mean_rssi"))
    return heard.withColumns({"distance_m": metres, "bucket": distance_bucket(metres)})


def model_diagnostics(scored: DataFrame, eps: DataFrame, quality: DataFrame, rate: DataFrame, *, by=BY,
                      contamination: float = 0.10) -> DataFrame:
    """One row per session with the settings and outcomes of the three models."""
    base = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ips"), F.count_if("anomaly").alias("n_anomalies"))
    flags = rate.groupBy(*by).agg(F.max("threshold").alias("rate_threshold"), F.count_if("flagged").alias("rate_flagged"))
    return (base.withColumns({"contamination": F.lit(contamination), "min_samples": F.lit(2)})
            .join(eps.select(*by, "eps"), list(by), "left").join(quality, list(by), "left").join(flags, list(by), "left"))
