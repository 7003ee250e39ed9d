"""Steps that failed or grew too fast on larger tables."""

import glob
import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from packetloom.operators import common, features, neighbours, retrieval


def test_points_whose_values_differ_when_computed_again_keep_their_rows(spark):
    """As averages do whose partial sums arrive in another order."""
    noisy = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    x = spark.range(60).select(F.lit("S1").alias("session_id"), F.concat(F.lit("10.0.0."), "id").alias("ip"), noisy(F.col("id").cast("double")).alias("x"))
    near = neighbours.nearest_distances(x, ["x"], leaf=10).collect()
    assert len(near) == 60 and all(abs(r.d - 1) < 1e-6 for r in near)
    eps = spark.createDataFrame([("S1", 1.5)], "session_id string, eps double")
    found = neighbours.close_components(x, eps, ["x"], leaf=10).collect()
    assert len(found) == 60 and {r.size for r in found} == {60}


def test_distinct_items_of_a_window_are_counted_without_the_events_of_the_window(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, 0.5]) + rng.randrange(400), rng.choice("abcdefg") if rng.random() < 0.9 else None) for k in "xy" for _ in range(300)] + [("z", 1.0, None)]
    frame = spark.createDataFrame(rows, "k string, t double, i string")
    for width in (3, 30, 0.25):
        got = common.max_distinct_in_window(frame, ["k"], "t", "i", width)
        want = {k: max(len({i for q, u, i in rows if q == k and t - width <= u <= t and i}) for p, t, _ in rows if p == k) for k in "xyz"}
        assert {r.k: r.best for r in got.collect()} == want
    assert "collect_set" not in got._jdf.queryExecution().toString()


def test_pieces_leave_a_task_in_small_batches():
    schema = pa.schema([("source", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("ord", pa.int32()), ("text", pa.string())])
    texts = ["word. " * 40_000, None, "", "short"] * 8
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(len(texts))]), pa.array([[("kind", "file")]] * len(texts), schema.field("meta").type), pa.array(texts)],
                                       names=["source", "meta", "_text"])
    out = list(retrieval._pieces(1000, 150, schema)(iter([batch])))
    assert max(b.nbytes for b in out) < 3 * retrieval.PIECES
    assert [(r["source"], r["ord"], r["text"]) for b in out for r in b.to_pylist()] == [
        (f"d{i}", j, p) for i, t in enumerate(texts) for j, p in enumerate(retrieval.split_text(t))]


def test_scores_of_equal_vectors_are_equal_wherever_they_lie():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64)).astype("float32")
    v = base[rng.integers(0, 40, 997)]
    stored = pd.DataFrame({"chunk_id": np.arange(997), "vec": list(v)})
    got = retrieval._scorer("chunk_id", "vec", 6)(pd.DataFrame({"query_id": np.arange(997), "vec": list(v), "_least": -2.0}), stored)
    unit = retrieval._unit(v)
    s = np.einsum("ij,kj->ik", unit, unit)
    for q, part in got.groupby("query_id"):
        equal = np.flatnonzero((v == v[q]).all(axis=1))[:6]
        assert part["chunk_id"].tolist()[:len(equal)] == equal.tolist() and len(part) == 6
        assert np.allclose(part["score"], np.sort(s[:, q])[::-1][:6], atol=1e-12)


def test_visits_of_queries_leave_a_task_in_small_batches():
    """before, the vectors of all visits of a batch were copied at once, one for every query and cell."""
    rng = np.random.default_rng(9)
    pivots, v = retrieval._unit(rng.normal(size=(60, 16))), list(rng.normal(size=(1_300, 16)))
    cells = {i: (10, 0.4) for i in range(60)}
    asked = pd.DataFrame({"query_id": np.arange(1_300), "vec": v, "_least": -2.0})
    for turn in (0, 1):
        found = list(retrieval._visits("vec", pivots, cells, 6, turn)(iter([asked.iloc[:0], asked])))
        assert max(map(len, found)) <= retrieval.VISITS_AT_ONCE
        angle = np.arccos(np.clip(retrieval._unit(v) @ pivots.T, -1, 1))
        nearest = set(zip(range(1_300), angle.argmin(axis=1).tolist(), strict=True))
        met = [(q, c) for b in found for q, c in zip(b["query_id"], b["_cell"], strict=True)]
        assert len(met) == len(set(met)) and set(met) == (nearest if not turn else {(q, c) for q in range(1_300) for c in range(60)} - nearest)
    placed = list(retrieval._placed("vec", pivots)(iter([asked[["query_id", "vec"]]])))
    assert len(placed) == 3 and np.concatenate([b["_cell"] for b in placed]).tolist() == angle.argmin(axis=1).tolist()


def test_visits_leave_a_task_in_small_batches(spark, monkeypatch):
    rows = pd.DataFrame({"session_id": "S1", "ip": [str(i) for i in range(3_000)], "leaf": 0, "v": [np.zeros(2)] * 3_000})
    boxes = {("S1",): (np.arange(1, 51), np.zeros((50, 2)), np.ones((50, 2)))}
    kept = []
    fake = spark.createDataFrame(rows.iloc[:1].assign(v=[[0.0, 0.0]]), "session_id string, ip string, leaf bigint, v array<double>")
    monkeypatch.setattr(type(fake), "mapInPandas", lambda self, f, schema: kept.append(f) or self)
    monkeypatch.setattr(neighbours, "staged", lambda df: df)
    neighbours._visits(fake, ["session_id"], boxes, lambda r, leaves, near, far: (near >= 0, near < 0), [])
    seen = [len(x) for x in kept[0](iter([rows]))]
    assert sum(seen) == 3_000 * 50 and max(seen) <= neighbours.SENT


def test_a_larger_feed_is_several_files_per_part_in_order_of_time(spark, monkeypatch):
    from catalog import live

    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(live, "FEED_ROWS", 500)
    monkeypatch.setattr(live, "_text", {})
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    path = live.feed_folder(spark, sf).removeprefix("file:")
    n = live.feed_files(spark, sf)
    files = sorted(glob.glob(f"{path}/*.txt"), key=os.path.getmtime)
    assert n == rows // 2_500 > 1 and len(files) == 5 * n + 1
    at = [[float(line.split("|")[0]) for line in open(f)] for f in files]
    assert sum(map(len, at)) == rows + 1 and len(at[-1]) == 1
    parts = [[t for x in at[i:i + n] for t in x] for i in range(0, 5 * n, n)]
    assert all(max(a) < min(b) for a, b in zip(parts, parts[1:]))


def test_large_tables_are_dealt_into_tasks_of_bounded_size(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("S1", f"h{rng.randrange(30)}", f"d{rng.randrange(40)}", rng.choice([7, rng.randrange(3000), None]), rng.choice(["0x0002", "0x0004", None])) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "session_id string, ip_src string, ip_dst string, len bigint, tcp_flags string")
    plain = sorted(features.ip_features(frame).collect())
    monkeypatch.setattr(common, "TASK_ROWS", 100)
    found = features.ip_features(frame)
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in sorted(found.collect())] == [
        tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in plain]
    cuts = common.quantiles(frame, ["session_id", "ip_src"], "len", (0.25, 0.5, 0.95), ("a", "b", "c"), rows=len(rows))
    for r in cuts.collect():
        assert np.allclose([r.a, r.b, r.c], np.quantile([x[3] for x in rows if x[1] == r.ip_src and x[3] is not None], [0.25, 0.5, 0.95]))
    assert cuts.count() == 30
    for df in (found, cuts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The first grouping takes the rows as they were dealt, in 40 tasks instead of the session's 8.
        assert ", 40), REPARTITION_BY_NUM" in plan
