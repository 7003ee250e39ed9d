"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every group. ``row_number() <= n`` lets Spark cut each group before the shuffle
    (window group limit), so a group of any size sends at most ``n`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


#: Rows that a task groups at once, about, where a table is dealt by their number.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df dealt by the keys into tasks of about TASK_ROWS, if the session's shuffle partitions would be larger, else df itself.

    A grouping by these keys (and more) that follows needs no further shuffle, so the memory of a task does not grow with the table.
    Rows that are equal on all the keys meet in one task, which a grouping takes one by one."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Row count per key, over rows where every key is present."""
    present = None
    for k in keys:
        test = F.col(k).isNotNull()
        present = test if present is None else present & test
    return df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def members_text(pairs: DataFrame, keys: Sequence[str], value: str, out: str, limit: int = 1000,
                 total: str | None = None, sep: str = ";") -> DataFrame:
    """One row per key: its distinct values sorted and joined, at most ``limit`` of them, and how many there
    are in all. ``pairs`` must be distinct on keys + value; the full list stays available there."""
    heads = (top_per_group(pairs, keys, [F.col(value)], limit, "_rank").groupBy(*keys)
             .agg(F.array_join(F.sort_array(F.collect_list(value)), sep).alias(out)))
    if total is None:
        return heads
    sizes = pairs.groupBy(*keys).agg(F.count(value).alias(total))
    return heads.join(sizes, list(keys))


def gaps(df: DataFrame, keys: Sequence[str], ts: str = "ts", slice_s: float = 3600.0) -> DataFrame:
    """Time since the previous event of the same key, one row per event (NULL for the first).

    The sort is cut into time slices so that no key is ordered in one task: the window runs inside
    (key, slice), and the first event of a slice takes its predecessor from the slice maxima, of which there
    is one row per slice."""
    sliced = df.select(*keys, F.col(ts).alias("ts")).withColumn("_slice", F.floor(F.col("ts") / slice_s))
    inner = Window.partitionBy(*keys, "_slice").orderBy("ts")
    inside = (sliced.withColumn("prev_ts", F.lag("ts").over(inner)).where(F.col("prev_ts").isNotNull())
              .select(*keys, "ts", "prev_ts"))
    outer = Window.partitionBy(*keys).orderBy("_slice")
    edges = (sliced.groupBy(*keys, "_slice").agg(F.min("ts").alias("ts"), F.max("ts").alias("_last"))
             .withColumn("prev_ts", F.lag("_last").over(outer)).select(*keys, "ts", "prev_ts"))
    return inside.unionByName(edges).withColumn("gap", F.col("ts") - F.col("prev_ts"))


def max_distinct_in_window(df: DataFrame, keys: Sequence[str], ts: str, item: str, width_s: float,
                           out: str = "best") -> DataFrame:
    """Largest number of distinct items of a key inside any trailing window of ``width_s`` (both ends in).

    Time is cut into slices as wide as the window, so events of an item in one slice always follow each other within a window and only
    its first and last one there matter: the events are reduced to these before the shuffle. An item is in the window from the first
    event of a run to a width behind its last one; the items that are there are a running sum over entries and exits, cut into slices."""
    keys = list(keys)
    width = round(width_s * 1e6)  # whole microseconds, so that widths under a second count too
    events = df.where(F.col(ts).isNotNull()).select(
        *keys, F.round(F.col(ts).cast("double") * 1e6).cast("bigint").alias("_ts"), F.col(item).alias("_item"))
    ends = events.groupBy(*keys, "_item", F.floor(F.col("_ts") / width).alias("_slice")).agg(
        F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
    of_item = Window.partitionBy(*keys, "_item").orderBy("_slice")
    far = lambda gap: F.coalesce(gap > width, F.lit(True))
    counted = F.col("_item").isNotNull()
    steps = ends.withColumns({"_in": far(F.col("_lo") - F.lag("_hi").over(of_item)), "_out": far(F.lead("_lo").over(of_item) - F.col("_hi"))}).select(
        *keys, F.inline(F.array(F.struct(F.col("_lo").alias("_at"), F.when(counted & F.col("_in"), 1).otherwise(0).alias("_d")),
                                F.struct((F.col("_hi") + width + 1).alias("_at"), F.when(counted & F.col("_out"), -1).otherwise(0).alias("_d")))))
    steps = steps.groupBy(*keys, "_at").agg(F.sum("_d").alias("_d")).withColumn("_slice", F.floor(F.col("_at") / width))
    inner = Window.partitionBy(*keys, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    peaks = steps.withColumn("_run", F.sum("_d").over(inner)).groupBy(*keys, "_slice").agg(
        F.max("_run").alias("_most"), F.sum("_d").alias("_sum"))
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(outer), F.lit(0))
    return peaks.withColumn("_n", before + F.col("_most")).groupBy(*keys).agg(F.max("_n").cast("bigint").alias(out))


def components(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node, root: the smallest node that the links (a, b) of the same keys reach from each node that has a link.

    Every round replaces each label by the least one among the node, its neighbours and the label's own label, and is written to the
    checkpoint folder. The labels only fall, so their changes end; labels that jump make the number of rounds small."""
    keys = list(keys)
    both = staged(links.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = staged(both.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), [*keys, "other"]).select(*keys, "node", "root")
        jump = labels.select(*keys, "node", F.col("root").alias("_r")).join(
            labels.select(*keys, F.col("node").alias("_r"), "root"), [*keys, "_r"]).select(*keys, "node", "root")
        least = near.unionByName(jump).groupBy(*keys, "node").agg(F.min("root").alias("_new"))
        both_labels = staged(labels.join(least, [*keys, "node"]).select(*keys, "node", F.col("root").alias("_old"), F.least("root", "_new").alias("root")))
        labels = both_labels.drop("_old")
        if both_labels.where("root <> _old").isEmpty():
            return labels


def value_cell(value: Column) -> Column:
    """Monotone cell number of a value, about 0.001 % wide: few distinct values share a cell."""
    return F.floor(F.signum(value) * F.log2(1 + F.abs(value) * 1e6) * 64_000).cast("bigint")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float],
              names: Sequence[str], rows: int = 0) -> DataFrame:
    """Exact linear-interpolated quantiles per key, without holding the values of a key in one task. ``rows`` is the size of df where
    it is known; a large table is dealt into tasks by it."""
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn(
        "_cell", value_cell(F.col("_v")))
    tally = dealt(present, rows, *keys, "_cell").groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return _tally_quantiles(tally, keys, fractions, names, rows)


def value_tally(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Equal values counted: keys, _v, _c."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))


def tally_quantiles(tally: DataFrame, keys: Sequence[str], fractions: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Quantiles of counted values. The counts are summed into narrow cells, the cell of each wanted position
    is found from the running cell totals, and only the values of those cells are ordered."""
    return _tally_quantiles(tally.withColumn("_cell", value_cell(F.col("_v"))), keys, fractions, names)


def _tally_quantiles(tally: DataFrame, keys: Sequence[str], fractions: Sequence[float], names: Sequence[str],
                     rows: int = 0) -> DataFrame:
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("_cell")
    cells = dealt(tally.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_n")), rows, *keys).withColumns({
        "_upto": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_rows": F.sum("_n").over(Window.partitionBy(*keys))})
    at = [F.lit(float(f)) * (F.col("_rows") - 1) for f in fractions]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), side(a).cast("bigint").alias("pos"), (a - F.floor(a)).alias("part"))
                       for i, a in enumerate(at) for side in (F.floor, F.ceil)])
    targets = cells.select(*keys, "_cell", (F.col("_upto") - F.col("_n")).alias("_below"), "_upto",
                           F.inline(wanted)).where((F.col("pos") >= F.col("_below")) & (F.col("pos") < F.col("_upto")))
    run = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tally.join(targets.select(*keys, "_cell").distinct(), [*keys, "_cell"], "left_semi").withColumn(
        "_to", F.sum("_c").over(run))
    placed = ranked.join(targets.drop("_upto"), [*keys, "_cell"]).where(
        (F.col("pos") - F.col("_below") < F.col("_to")) & (F.col("pos") - F.col("_below") >= F.col("_to") - F.col("_c")))

    def interpolated(i):
        mine = F.when(F.col("i") == i, F.col("_v"))
        part = F.max(F.when(F.col("i") == i, F.col("part")))
        return F.min(mine) + (F.max(mine) - F.min(mine)) * part

    return placed.groupBy(*keys).agg(*[interpolated(i).alias(n) for i, n in enumerate(names)])


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value)


def any_of(column: Column, values) -> Column:
    return F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])), F.lit(False))
