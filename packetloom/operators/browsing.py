"""Time-bucket views of names and traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify_domain, registrable_simple
from .common import top_per_group
from .features import BY, dns_timeline, timeline


def _browsed(packets: DataFrame, device_names: DataFrame | None, by) -> DataFrame:
    rows = dns_timeline(packets, by=by)
    rows = rows.where(~F.col("qname").endswith(".local") & ~F.col("qname").endswith(".arpa"))
    if device_names is not None:
        rows = rows.join(device_names.select(*by, "ip", F.col("name").alias("_name")), [*by, "ip"], "left")
        return rows.withColumn("device", F.coalesce("_name", "ip")).drop("_name")
    return rows.withColumn("device", F.col("ip"))


def browsing_by_category(packets: DataFrame, device_names: DataFrame | None = None, *, by=BY,
                         min_queries: int = 5) -> DataFrame:
    """Queries per device and category with the share inside the device."""
    keys = [*by, "device"]
    # Names are counted before they are classified: the patterns run once per (device, name).
    tally = _browsed(packets, device_names, by).groupBy(*keys, "qname").agg(F.count(F.lit(1)).alias("n"))
    cats = tally.groupBy(*keys, classify_domain(F.col("qname")).alias("category")).agg(F.sum("n").alias("count"))
    return share_within(cats, keys, "count").where(F.col("_total") >= min_queries).drop("_total")


def share_within(df: DataFrame, keys, value: str, out: str = "pct") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("_total", total).withColumn(out, F.col(value) / F.col("_total") * 100)


def session_bounds(packets: DataFrame, *, by=BY) -> DataFrame:
    return packets.groupBy(*by).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))


def browsing_by_bins(packets: DataFrame, device_names: DataFrame | None = None, *, by=BY, bin_s: int = 300,
                     min_queries: int = 5) -> DataFrame:
    """Queries per active device and epoch-aligned bin, with zeros for the silent bins of the session."""
    keys = [*by, "device"]
    start = lambda c: F.floor(F.floor(c) / bin_s) * bin_s
    bounds = session_bounds(packets, by=by).select(
        *by, F.explode(F.sequence(start(F.col("t0")).cast("bigint"), start(F.col("t1")).cast("bigint"),
                                  F.lit(bin_s).cast("bigint"))).alias("bin_start"))
    binned = _browsed(packets, device_names, by).groupBy(*keys, start(F.col("ts")).cast("bigint").alias("bin_start")).agg(
        F.count(F.lit(1)).alias("n"))
    active = binned.groupBy(*keys).agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_queries).select(*keys)
    grid = active.join(bounds, list(by))
    return grid.join(binned, [*keys, "bin_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ip_domain_heatmap(packets: DataFrame, ip: str, *, by=BY, bins: int = 30, n: int = 25) -> DataFrame:
    """Queries of one address by time bin and domain, for its most queried domains."""
    span = session_bounds(packets, by=by)
    rows = _browsed(packets.where(F.col("ip_src") == ip), None, by).withColumn("domain", registrable_simple(F.col("qname")))
    top = top_per_group(rows.groupBy(*by, "domain").agg(F.count(F.lit(1)).alias("_n")), by,
                        [F.desc("_n"), F.asc("domain")], n).select(*by, "domain")
    width = F.greatest(F.lit(1.0), F.col("t1") - F.col("t0")) / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("ts") - F.col("t0")) / width)))
    return (rows.join(top, [*by, "domain"], "left_semi").join(span, list(by))
            .groupBy(*by, "domain", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


#: Bins that one task generates and orders together.
SLICE = 3600


def rate_series(packets: DataFrame, *, by=BY, bin_s: float = 1.0) -> DataFrame:
    """Mean packet size of every bin of ``bin_s`` seconds, 0 in silent bins, for the whole session: bins are numbered from 0 without
    gaps, and every packet is in one of them. The bins are generated slice by slice."""
    rows = timeline(packets, by=by)
    start = rows.groupBy(*by).agg(F.min("time").alias("_t0"), F.max("time").alias("_t1"))
    at = lambda time: F.floor((F.col(time) - F.col("_t0")) / bin_s)
    filled = rows.join(start, list(by)).groupBy(*by, at("time").alias("bin")).agg(F.avg("size").alias("mean_size"))
    slices = start.withColumn("_last", at("_t1")).withColumn("_s", F.explode(F.expr(f"sequence(0L, _last div {SLICE})")))
    grid = slices.select(*by, F.explode(F.expr(f"sequence(_s * {SLICE}, least(_last, _s * {SLICE} + {SLICE - 1}))")).alias("bin"))
    return grid.join(filled, [*by, "bin"], "left").select(
        *by, "bin", F.floor(F.col("bin") * bin_s).alias("second"), F.coalesce("mean_size", F.lit(0.0)).alias("mean_size"))


def lag_sequences(series: DataFrame, *, by=BY, order: str = "bin", value: str = "mean_size", lags: int = 10) -> DataFrame:
    """Each value with the ``lags`` values before it; the first ``lags`` rows have none and are left out.

    ``order`` numbers the rows without gaps. A window holds one slice of it: the last rows of a slice are copied to the next one."""
    home = F.floor(F.col(order) / SLICE)
    both = F.when(F.pmod(order, F.lit(SLICE)) >= SLICE - lags, F.array(home, home + 1)).otherwise(F.array(home))
    w = Window.partitionBy(*by, "_slice").orderBy(order)
    out = series.withColumn("_slice", F.explode(both)).withColumns({f"lag_{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)})
    return out.where((F.col("_slice") == home) & F.col(f"lag_{lags}").isNotNull()).drop("_slice").withColumnRenamed(value, "target")


def chronological_split(rows: DataFrame, *, by=BY, order: str = "bin", share: float = 0.8) -> DataFrame:
    """Whether a row is among the first ``share`` of its session; ``order`` numbers the rows from 0 without gaps."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, list(by)).withColumn("is_train", F.col(order) < F.floor(F.col("_n") * share)).drop("_n")
