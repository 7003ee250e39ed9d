"""Skew-safe building blocks against brute force on small fixtures."""

import ipaddress
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetloom.functions import is_local_scope, is_private, is_public
from packetloom.operators import common, history, inventory, neighbours, providers, retrieval, scoring
from packetloom.sources import packets as P, tables as S


def test_address_scopes_follow_the_standard_library(spark):
    rng = random.Random(5)
    ips = ["", "x", "1.2.3", "1.2.3.256", "01.2.3.4"]
    for base in ("0.0.0.0", "10.0.0.0", "100.64.0.0", "127.0.0.0", "169.254.0.0", "172.16.0.0", "172.32.0.0", "192.0.0.0", "192.0.2.0",
                 "192.168.0.0", "198.18.0.0", "198.20.0.0", "198.51.100.0", "203.0.113.0", "224.0.0.0", "239.255.255.0", "240.0.0.0", "8.8.8.0"):
        n = int(ipaddress.ip_address(base))
        ips += [str(ipaddress.ip_address(min(max(n + d, 0), 2**32 - 1))) for d in (-1, 0, 1, 9, 10, 255, 256)]
    ips += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(300)]
    ips += ["::1", "::", "fe80::1", "fd12::3", "ff02::1", "2001:4860:4860::8888", "2001:db8::1"]
    c = F.col("ip")
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", is_private(c).alias("p"), is_local_scope(c).alias("l"), is_public(c).alias("g")).collect()
    for r in got:
        try:
            a = ipaddress.ip_address(r.ip)
        except ValueError:
            assert (r.p, r.l, r.g) == (False, False, False), r
            continue
        assert r.p == a.is_private, r
        assert r.l == (a.is_private or a.is_link_local or a.is_loopback or a.is_multicast or a.is_unspecified), r
        if not a.is_multicast:
            assert r.g == a.is_global, r


def test_dotted_numbers_past_255_belong_to_the_block_they_begin_with(spark):
    want = {"10.0.449.200": (True, True), "192.168.2.256": (True, True), "230.1.300.1": (False, True), "52.10.300.1": (False, False),
            "10.0.300": (False, False), "10.0.300.x": (False, False)}
    got = spark.createDataFrame([(i,) for i in want], "ip string").select("ip", is_private(F.col("ip")).alias("p"), is_local_scope(F.col("ip")).alias("l")).collect()
    assert {r.ip: (r.p, r.l) for r in got} == want


@pytest.mark.parametrize("block", [7, 2000])
def test_silhouette_equals_all_pairs_and_takes_equal_points_once(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 20, (6, 2))
    rows = [(f"10.0.{c}.{i}", c, *(centres[c] + rng.normal(0, 1, 2)).tolist()) for c in range(6) for i in range(30 if c == 0 else 4)]
    rows += [(f"10.1.{r[0][5:]}.{k}", *r[1:]) for r in rows[:40] for k in range(9)]  # copies
    rows += [("10.9.9.9", -1, 500.0, 500.0)]
    df = spark.createDataFrame([("S1", *r) for r in rows], "session_id string, ip string, cluster int, x double, y double")
    got = scoring.silhouette(df.drop("cluster"), df.select("session_id", "ip", "cluster"), ["x", "y"], block=block).collect()
    v, c = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    s = []
    for i in np.flatnonzero(c >= 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        a = d[(c == c[i])].sum() / ((c == c[i]).sum() - 1)
        b = min(d[c == k].mean() for k in range(6) if k != c[i])
        s.append((b - a) / max(a, b))
    assert [(r.n_clusters, r.n_noise) for r in got] == [(6, 1)] and math.isclose(got[0].silhouette, np.mean(s), abs_tol=1e-9)
    met = scoring._block_pairs(df.where("cluster >= 0").groupBy("session_id", "cluster", "x", "y").agg(F.min("ip").alias("ip"), F.count("*").alias("n")), ["session_id"], 2000)
    assert met.count() == 50


def test_distances_of_two_blocks_are_taken_once_and_near_points_keep_their_digits(monkeypatch):
    """before, the distances of two blocks were taken twice, dimension by dimension."""
    rng = np.random.default_rng(3)
    made = lambda m, of: pd.DataFrame(rng.normal(size=(m, 4)) * 100, columns=list("wxyz")).assign(ip=[f"{of}{i}" for i in range(m)], cluster=of + np.arange(m) % 7, n=rng.integers(1, 4, m))
    a, b = made(130, 0), made(90, 100)
    b.loc[:40, list("wxyz")] = a.loc[:40, list("wxyz")].to_numpy() + 1e-7 * (np.arange(41) % 2)[:, None]
    taken = []
    monkeypatch.setattr(scoring, "_distances", lambda x, y, f=scoring._distances: taken.append(len(x) * len(y)) or f(x, y))
    got = scoring._block_sums(a, b, list("wxyz"), True)
    assert sum(taken) == 130 * 90
    d = np.sqrt(((a[list("wxyz")].to_numpy()[:, None] - b[list("wxyz")].to_numpy()[None]) ** 2).sum(axis=2))
    assert np.allclose(scoring._distances(a[list("wxyz")].to_numpy(), b[list("wxyz")].to_numpy()), d, rtol=1e-8, atol=1e-12)
    for left, right, between in ((a, b, d), (b, a, d.T)):
        part = got[got["ip"].isin(left["ip"])] if left is b else got.iloc[:len(a)]
        part = part[part["cluster"].isin(left["cluster"])].set_index("ip")
        for i, ip in enumerate(left["ip"]):
            means = {c: (between[i] * right["n"] * (right["cluster"] == c)).sum() / right["n"][right["cluster"] == c].sum() for c in set(right["cluster"])}
            row = part.loc[ip]
            assert row["other"] == min(means, key=means.get) and abs(row["total"] / row["size"] - means[row["other"]]) < 1e-6


def test_quantiles_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    data = {"hot": np.round(rng.exponential(50, 4000), 3), "ties": np.repeat([5.0, 7.0], 300), "one": np.array([3.5]), "neg": rng.normal(0, 2, 101)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    q = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = common.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", q, [f"q{i}" for i in range(len(q))])
    for r in got.collect():
        assert np.allclose(r[1:], np.percentile(data[r.k], [100 * x for x in q])), r.k


def test_gaps_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(k, round(rng.uniform(0, 50_000), 2)) for k in "ab" for _ in range(300)] + [("c", 9.0)]
    got = common.gaps(spark.createDataFrame(rows, "k string, ts double"), ["k"], slice_s=100.0)
    for k in "abc":
        times = sorted(t for key, t in rows if key == k)
        want = sorted([(t, p) for p, t in zip(times, times[1:])] + [(times[0], None)], key=str)
        assert sorted(((r.ts, r.prev_ts) for r in got.where(F.col("k") == k).collect()), key=str) == want


def test_max_distinct_in_window(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.randrange(5000)), rng.choice("uvwxyz")) for _ in range(200)]
    best = max(len({i for _, t2, i in rows if t - 60 <= t2 <= t}) for _, t, _ in rows)
    got = common.max_distinct_in_window(spark.createDataFrame(rows, "k string, t double, i string"), ["k"], "t", "i", 60)
    assert got.first().best == best


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    plan = common.top_per_group(df, ["k"], [F.desc("v")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cidr_first_match_both_families(spark):
    p = providers.Providers(static=(("9.9.9.9", "S", "", ""),), cidrs=(("9.0.0.0/8", "A", "", ""), ("9.9.9.0/24", "B", "", ""), ("2001:db8::/33", "C", "", "")))
    ips = spark.createDataFrame([("9.9.9.9",), ("9.9.9.8",), ("2001:db8:1::5",), ("2001:db8:8000::5",), ("bad",)], "ip string")
    assert {(r.ip, r.provider) for r in p.by_ip(ips).collect()} == {("9.9.9.9", "S"), ("9.9.9.8", "A"), ("2001:db8:1::5", "C")}


def _features(spark, n=400):
    rng = np.random.default_rng(0)
    cols = ("mean_len", "std_len", "count", "burst_score", "unique_dsts", "syn_count", "rst_count", "fin_count", "null_count", "xmas_count")
    rows = [("S1", f"10.0.{i // 250}.{i % 250}", *map(float, rng.normal(50, 3, 10))) for i in range(n)]
    rows += [("S1", f"192.168.9.{i}", *([500.0 + i] * 10)) for i in range(3)]
    return spark.createDataFrame(rows, "session_id string, ip string, " + ", ".join(f"{c} double" for c in cols))


def test_forest_finds_planted_outliers_and_is_repeatable(spark):
    f = _features(spark)
    a = {r.ip: r.iso_score for r in scoring.isolation_forest(f, trees=60).collect()}
    b = {r.ip: r.iso_score for r in scoring.isolation_forest(f.repartition(5), trees=60).collect()}
    assert set(sorted(a, key=a.get)[:3]) == {f"192.168.9.{i}" for i in range(3)}
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    assert abs(sum(v < 0 for v in a.values()) - 0.1 * len(a)) <= 2


def _points(spark, groups):
    cols = scoring.FEATURES_MODEL
    rows = [(g, f"h{i:04d}", *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "session_id string, ip string, " + ", ".join(f"{c} double" for c in cols))


def _clouds(seed):
    """Blobs, a line of close points, outliers in one dimension, and repeated points; small groups beside large ones."""
    rng = np.random.default_rng(seed)
    blob = rng.normal(0, 1, (150, 10)) * rng.choice([0.01, 0.3, 1], 10)
    line = np.zeros((60, 10))
    line[:, 4] = np.arange(60) * 0.3 + 8
    far = np.zeros((8, 10))
    far[:, rng.integers(10)] = rng.normal(0, 300, 8)
    copies = np.repeat(rng.normal(3, 1, (3, 10)), [40, 2, 1], axis=0)
    return {"S1": np.concatenate([blob, line, far, copies]), "S2": blob[:3], "S3": blob[:1], "S4": copies[:40], "S5": np.concatenate([line[:5], line[:5] + 0.5, line[20:21]]), "S6": rng.integers(0, 3, (200, 10)).astype(float)}


def _distances_of(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("seed,leaf", [(1, 400), (2, 4), (3, 30)])
def test_nearest_neighbours_and_elbow(spark, seed, leaf):
    groups = _clouds(seed)
    x = _points(spark, groups)
    near = neighbours.nearest_distances(x, scoring.FEATURES_MODEL, leaf=leaf)
    got = {(r.session_id, r.ip): r.d for r in near.collect()}
    assert len(got) == sum(map(len, groups.values()))
    bends = {r.session_id: r for r in neighbours.elbow(near).collect()}
    for g, v in groups.items():
        d = _distances_of(v)
        np.fill_diagonal(d, np.inf)
        want = np.where(np.isinf(d.min(axis=1)), 0, d.min(axis=1))
        assert np.allclose([got[g, f"h{i:04d}"] for i in range(len(v))], want, atol=1e-9)
        falling = np.sort([got[g, f"h{i:04d}"] for i in range(len(v))])[::-1]
        assert bends[g].n_points == len(v) and bends[g]["mean"] == pytest.approx(falling.mean())
        bend = np.round(np.diff(np.diff(falling)), 9)
        assert bends[g].elbow == (falling[int(np.argmin(bend)) + 1] if len(v) > 2 else None)


@pytest.mark.parametrize("seed,radius", [(1, 0.05), (2, 0.35), (3, 1.0), (1, 1.0), (2, 4.0), (3, 1000.0)])
def test_dbscan_is_components_of_close_points(spark, monkeypatch, seed, radius):
    monkeypatch.setattr(neighbours.close_components, "__kwdefaults__", {**neighbours.close_components.__kwdefaults__, "leaf": 15})
    groups = _clouds(seed)
    eps = spark.createDataFrame([(g, radius) for g in groups], "session_id string, eps double")
    got = {(r.session_id, r.ip): r.cluster for r in scoring.dbscan(_points(spark, groups), eps).collect()}
    for g, v in groups.items():
        close = _distances_of(v) <= radius
        root, n = [-1] * len(v), 0
        for i in range(len(v)):
            if root[i] < 0 and close[i].sum() > 1:
                root[i], todo = n, [i]
                while todo:
                    for j in np.flatnonzero(close[todo.pop()]):
                        if root[j] < 0:
                            root[j] = n
                            todo.append(j)
                n += 1
        assert [got[g, f"h{i:04d}"] for i in range(len(v))] == root


def test_neighbours_of_many_hosts(spark):
    """20,000 hosts, half of them equal."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (20_000, 10)) * np.array([1, 1, 1, 0.5, 0.2, 0.1, 0, 0, 0, 0])
    v[:10_000] = v[0]
    x = _points(spark, {"S1": v}).persist()
    near = neighbours.nearest_distances(x, scoring.FEATURES_MODEL)
    eps = scoring.knn_elbow_eps(x).first().eps
    found = scoring.dbscan(x, spark.createDataFrame([("S1", eps)], "session_id string, eps double"))
    assert near.where("d = 0").count() == 10_000 and found.count() == 20_000
    sample = rng.choice(np.arange(10_000, 20_000), 50, replace=False)
    got = {r.ip: r.d for r in near.where(F.col("ip").isin([f"h{i:04d}" for i in sample])).collect()}
    for i in sample:
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[f"h{i:04d}"] == pytest.approx(d.min())


def test_dbscan_of_a_session_with_many_hosts(spark):
    cols = scoring.FEATURES_MODEL
    rows = [("S1", f"h{i:05d}", *([1000.0 * (i % 3) + i // 3 * 0.001] + [0.0] * (len(cols) - 1))) for i in range(6000)] + [("S1", "lone", *([-500.0] * len(cols)))]
    x = spark.createDataFrame(rows, "session_id string, ip string, " + ", ".join(f"{c} double" for c in cols))
    eps = spark.createDataFrame([("S1", 6001, 0.5)], "session_id string, n_points bigint, eps double")
    got = {r.ip: r.cluster for r in scoring.dbscan(x, eps).collect()}
    assert got.pop("lone") == -1 and len(got) == 6000
    assert all(c == int(ip[1:]) % 3 for ip, c in got.items())


def test_components_of_chains(spark):
    rng = random.Random(8)
    nodes = [f"n{i:03d}" for i in range(60)]
    rng.shuffle(nodes)
    pairs = [("k", a, b) for a, b in zip(nodes[:40], nodes[1:40])] + [("k", a, b) for a, b in zip(nodes[40:], nodes[41:])] + [("l", "n0", "n9")]
    got = {(r.k, r.node): r.root for r in common.components(spark.createDataFrame(pairs, "k string, a string, b string"), ["k"]).collect()}
    want = {("k", n): min(part) for part in (nodes[:40], nodes[40:]) for n in part} | {("l", "n0"): "n0", ("l", "n9"): "n0"}
    assert got == want


def test_sessions_come_from_the_files(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.1.csv").write_text("1.5|60\n2.5|70\n")
    got = P.normalize_packets(P.read_packets(spark, [str(tmp_path / "a"), str(tmp_path / "b")], fields=("ts", "len")))
    assert sorted(("/".join(r.session_id.split("/")[-2:]), r.ts) for r in got.collect()) == [("a/x.1.csv", 1.5), ("a/x.1.csv", 2.5), ("b/x.1.csv", 1.5), ("b/x.1.csv", 2.5)]
    with pytest.raises(ValueError, match="session"):
        P.normalize_packets(got.drop("session_id"))


def test_live_lines_have_their_own_order(spark, tmp_path):
    (tmp_path / "feed.txt").write_text("1.5|60|m1|10.0.0.1|10.0.0.2|TCP|1|2|0x0002|||||||\n2.5|x|m2|||DNS||||5|53|a.example|3|True|||fd00::1|fd00::2\n3|1|short\n")
    stream = P.stream_packets(spark, str(tmp_path), session="S1")
    q = P.normalize_packets(stream).writeStream.format("memory").queryName("live_lines").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r.ts: r for r in spark.table("live_lines").collect()}
    assert set(rows) == {1.5, 2.5}
    assert (rows[1.5].ip_src, rows[1.5].eth_src, rows[1.5].tcp_dport, rows[1.5].tcp_flags, rows[1.5].dns_qname) == ("10.0.0.1", "m1", 2, "0x0002", None)
    assert (rows[2.5].ip_src, rows[2.5].ip_dst, rows[2.5].len, rows[2.5].dns_rcode, rows[2.5].dns_response, rows[2.5].udp_dport) == ("fd00::1", "fd00::2", 0, "3", "1", 53)


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_meet_once(spark, seed):
    rng = random.Random(seed)
    width = lambda: rng.choice([0, 1, 59, 3600, 86400, 3 * 10**6, 2 * 10**8])
    spans = [(f"S{i}", float(a := rng.randrange(10**9)), float(a + rng.random() * width())) for i in range(40)]
    log = [(i, float(a := rng.randrange(10**9)), a + rng.random() * width() - rng.choice([0, 0, 0, 5])) for i in range(300)] + [(999, spans[0][2] + 120, spans[0][2] + 130), (998, spans[1][1] - 500, spans[1][1] - 120)]
    got = history.overlapping_rows(spark.createDataFrame(spans, "session_id string, t0 double, t1 double"), spark.createDataFrame(log, "id bigint, started_at double, ended_at double")).collect()
    want = [(s, i) for s, a, b in spans for i, x, y in log if x <= y and x <= b + 120 and y >= a - 120]
    assert sorted((r.session_id, r.id) for r in got) == sorted(want) and ("S0", 999) in want


def test_names_inside_addresses(spark):
    rng = random.Random(9)
    ips = [f"10.{rng.randrange(3)}.{rng.randrange(30)}.{rng.randrange(30)}" for _ in range(60)] + ["FD00::1:ab", "fe80::" + "1:" * 15 + "1"]
    names = ["10.0.local", "0.1.local", "1.2.local", ".local", "d00::1:AB.local", "x10.local", "9.local", "10.2.2.22.local", "1" * 60 + ".local"] + [f"{i}.{i}.local" for i in range(12)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.ip: r.name for r in inventory.name_devices(df([("S", i) for i in ips], "session_id string, ip string"), df([("S", n) for n in names] + [("T", "10.local")], "session_id string, qname string")).collect()}
    want = {}
    for ip in ips:
        hits = [n for n in names if (b := n.replace(".local", "").lower()) and set(b) <= set("0123456789abcdef.:") and b in ip.lower()]
        if hits:
            want[ip] = max(hits)
    assert got == want and len(got) > 20


def test_rate_anomaly_flags_a_burst(make):
    rows = [dict(ts=i + 0.5, len=100 + 10 * (i % 5), ip_src="10.0.0.1", ip_dst="10.0.0.2") for i in range(300)]
    rows[250]["len"] = 5000
    got = scoring.rate_anomaly(make(rows)).where("flagged").collect()
    assert 250 in {r.second for r in got} and len(got) < 15
    few = scoring.rate_anomaly(make(rows[:19])).collect()
    assert len(few) == 19 and all(r.short and not r.flagged and r.error is None for r in few)
    assert scoring.error_histogram(scoring.rate_anomaly(make(rows[:19]))).count() == 0


def test_rate_model_is_least_squares(make):
    rng = random.Random(6)
    rows = [dict(ts=i + rng.random() * 0.9, len=rng.randint(60, 1500), ip_src="10.0.0.1", ip_dst="10.0.0.2") for i in range(400) for _ in range(rng.choice([0, 1, 3]))]
    got = sorted(scoring.rate_anomaly(make(rows), lags=4).collect(), key=lambda r: r.bin)
    t0 = min(float(r["ts"]) for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(int(float(r["ts"]) - t0), []).append(r["len"])
    x = np.array([np.mean(sizes.get(i, [0])) for i in range(max(sizes) + 1)])
    x = (x - x.min()) / (x.max() - x.min())
    a = np.array([[1, *x[i - 4:i][::-1]] for i in range(4, len(x))])
    cut = int((len(x) - 4) * 0.8)
    w = np.linalg.lstsq(a[:cut], x[4:4 + cut], rcond=None)[0]
    error = np.abs(a @ w - x[4:])
    assert [r.bin for r in got] == list(range(4, len(x))) and np.allclose([r.error for r in got], error, atol=1e-6)
    limit = error[cut:].mean() + 2 * error[cut:].std()
    assert got[0].threshold == pytest.approx(limit, abs=1e-6) and [r.flagged for r in got] == list(error > limit)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n?!\tü", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_chunks_cover_the_text(text, size, overlap):
    pieces = retrieval.split_text(text, size, overlap)
    squeezed = " ".join(text.replace("\t", " ").split())
    assert all(0 < len(p) <= size for p in pieces)
    words = set(squeezed.split())
    if max((len(w) for w in words), default=0) <= 3:
        got = " ".join(pieces).split()
        assert len("".join(got)) >= len(squeezed.replace(" ", ""))


def test_cosine_dimension_mismatch_is_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vec array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "chunk_id bigint, vec array<double>")
    with pytest.raises(Exception, match="dimension"):
        retrieval.cosine_topk(q, c).collect()


def test_cosine_slices_and_filter(spark):
    rng = np.random.default_rng(2)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(12)], "query_id bigint, vec array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=8).tolist(), {"kind": "a" if i % 2 else "b"}) for i in range(60)], "chunk_id bigint, vec array<double>, meta map<string,string>")
    one = {(r.query_id, r.chunk_id) for r in retrieval.cosine_topk(q, c, k=3, where={"kind": "a"}).collect()}
    cut = {(r.query_id, r.chunk_id) for r in retrieval.cosine_topk(q, c, k=3, where={"kind": "a"}, max_queries=4, max_chunks=7).collect()}
    assert one == cut and len(one) == 36 and all(c % 2 for _, c in one)


def test_packet_list(spark, tmp_path):
    (tmp_path / "list.csv").write_bytes('"No.","Time","Source","Length","Info"\n"1","0.5","10.0.0.1","60","caf\xe9"\n"2","x","10.0.0.2","y",\n'.encode("latin-1"))
    got = P.read_packet_list(spark, str(tmp_path / "list.csv")).orderBy("Source").collect()
    assert [(r.Time, r.Length, r.Info) for r in got] == [(0.5, 60, "café"), (0.0, 0, "")]


def test_verdict_archive(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "verdicts.json").write_text(json.dumps({
        "context": {"time_range": ["2024-01-01 10:00:00", "x"], "original_filename": "a.pcap"},
        "results": [{"candidate_id": "10.0.0.1", "verdict": {"verdict": "malicious", "category": "port_scan", "confidence": 0.9, "reasoning": "why"},
                     "evidence": {"device": {"vendor": "Acme", "hostname": None}, "trigger_reasons": ["scan_rule"]}}]}))
    (tmp_path / "7" / "summary.md").write_text("# All of it")
    row = S.read_verdict_archive(spark, str(tmp_path)).first()
    assert row.text == ("Session 7 (a.pcap, recorded 2024-01-01 10:00:00). IP 10.0.0.1 was judged malicious - category port_scan, confidence 0.9. "
                        "Device: Acme. Triggered by: scan_rule. Reasoning: why")
    assert row.meta["ip"] == "10.0.0.1" and row.source == "session:7:10.0.0.1"
    assert S.read_report_texts(spark, str(tmp_path)).first().text == "# All of it"


def test_cosine_cells_give_what_all_pairs_give(spark):
    import numpy as np
    from packetloom.operators import retrieval
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    points = [(centres[i % 12] + 0.1 * rng.normal(size=8)).tolist() for i in range(600)] + [[0.0] * 8] * 150 + [[1.0] + [0.0] * 7] * 150
    asked = [(centres[i % 12] + 0.3 * rng.normal(size=8)).tolist() for i in range(40)] + [[0.0] * 8, [1.0] + [0.0] * 7, [-1.0] + [0.0] * 7]
    c = spark.createDataFrame(list(enumerate(points)), "chunk_id int, vec array<double>")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, vec array<double>")
    unit = lambda rows: (lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n))(np.array(rows))
    score = unit(asked) @ unit(points).T
    for k, most in ((5, 20), (200, 50)):
        got = {}
        for r in retrieval.cosine_topk(q, c, k=k, max_queries=7, max_chunks=most).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
        for i in range(len(asked)):
            mine = [x[2] for x in sorted(got[i])]
            assert len(mine) == k and np.allclose(mine, np.sort(score[i])[::-1][:k], atol=1e-9)
            assert all(abs(score[i][x[1]] - x[2]) < 1e-9 for x in got[i])
            # Equal vectors tie exactly, the smaller ids come first.
            same = [x[1] for x in sorted(got[i]) if x[1] >= 600]
            assert all(set(range(lo, x)) <= set(same) for x in same for lo in [600 if x < 750 else 750])


def test_cosine_visits_only_cells_within_reach(spark):
    import numpy as np
    import pandas as pd
    from packetloom.operators import retrieval
    pivots = np.eye(4)
    cells = {i: (10, 0.1) for i in range(4)}
    one = pd.DataFrame({"query_id": [1], "vec": [[1.0, 0.05, 0.0, 0.0]], "_least": [0.99]})
    assert [list(x["_cell"]) for x in retrieval._visits("vec", pivots, cells, 3, 0)([one])] == [[0]]
    assert [list(x["_cell"]) for x in retrieval._visits("vec", pivots, cells, 3, 1)([one])] == [[]]
    assert [list(x["_cell"]) for x in retrieval._visits("vec", pivots, cells, 3, 1)([one.assign(_least=-2.0)])] == [[1, 2, 3]]


def test_cosine_without_index_or_queries(spark):
    from packetloom.operators import retrieval
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "chunk_id int, vec array<double>")
    q = c.withColumnRenamed("chunk_id", "query_id")
    assert retrieval.cosine_topk(q, c.where("false")).count() == 0 and retrieval.cosine_topk(q.where("false"), c).count() == 0
    assert [tuple(r) for r in retrieval.cosine_topk(q, c).select("query_id", "chunk_id", "score").collect()] == [(1, 1, 1.0)]
