"""Thresholds straddled on hand-made packets, with the default limits."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import engines as E, features as A, rankings as K, rules as D


def syn(src, dst, ts, flags="0x0002", session="S1", **kw):
    return dict(session_id=session, ts=ts, ip_src=src, ip_dst=dst, proto="TCP", tcp_flags=flags, **kw)


def test_scan_floor_spread_and_ratio(make):
    rows = []
    for host, n in (("10.0.0.50", 50), ("10.0.0.51", 51)):                    # floor: 51 fires, 50 does not
        rows += [syn(host, f"192.0.2.{i % 25}", i) for i in range(n)]
    rows += [syn("10.0.0.60", f"198.51.100.{i % 21}", i) for i in range(60)]   # spread, ratio 60/240 = .25
    rows += [syn("10.0.0.60", "198.51.100.1", i, "0x0010") for i in range(180)]
    rows += [syn("10.0.0.61", f"198.51.100.{i % 21}", i) for i in range(60)]   # ratio 60/239 > .25
    rows += [syn("10.0.0.61", "198.51.100.1", i, "0x0010") for i in range(179)]
    rows += [syn("10.0.0.70", "198.51.100.9", i) for i in range(70)]           # one target, ratio .70
    rows += [syn("10.0.0.70", "198.51.100.9", i, "0x0010") for i in range(30)]
    rows += [syn("10.0.0.71", "198.51.100.9", i, "0x0029") for i in range(71)]  # ratio .71
    rows += [syn("10.0.0.71", "198.51.100.9", i, "0x0010") for i in range(29)]
    got = {(r.src, r.type) for r in D.scan_alerts(A.ip_features(make(rows))).collect()}
    assert got == {("10.0.0.51", "SYN"), ("10.0.0.61", "SYN"), ("10.0.0.71", "XMAS")}


def test_ecn_syn_counts_but_is_no_start(make):
    p = make([syn("10.0.0.1", "10.0.0.2", 1, "0x00c2"), syn("10.0.0.1", "10.0.0.2", 2)])
    assert A.flag_counters(p).first().syn_count == 2
    from packetloom.functions import is_tcp_start
    assert p.where(is_tcp_start(F.col("proto"), F.col("tcp_flags"))).count() == 1


def test_flood_without_scan(make):
    rows = [syn(f"172.16.{i // 250}.{i % 250}", "10.0.0.9", i / 200) for i in range(1000)]
    p = make(rows)
    alert = D.syn_flood(p).collect()
    assert len(alert) == 1 and alert[0].spoofed_source_pattern and alert[0].total_syn == 1000
    assert D.scan_alerts(A.ip_features(p)).count() == 0
    assert D.syn_flood(make(rows[:999])).count() == 0


def test_amplification_limits(make):
    def answers(src, n, size):
        return [dict(ts=i, len=size, ip_src=src, ip_dst="10.0.0.1", udp_sport=53, dns_response="True", dns_qname="a.example") for i in range(n)]
    got = D.dns_amplification(make(answers("9.9.9.9", 50, 200) + answers("9.9.9.8", 49, 900) + answers("9.9.9.7", 60, 199)))
    assert [r.src for r in got.collect()] == ["9.9.9.9"]


def test_features_need_both_ends_flags_do_not(make):
    p = make([syn("10.0.0.1", "", 1), syn("10.0.0.2", "10.0.0.3", 2)])
    assert {r.ip for r in A.ip_features(p).collect()} == {"10.0.0.2"}
    assert {r.ip for r in A.flag_counters(p).collect()} == {"10.0.0.1", "10.0.0.2"}


def test_ipv6_is_used_and_v4_wins(make):
    p = make([dict(ts=1, ip6_src="fd00::1", ip6_dst="2600::1", tcp_flags="0x0002"),
              dict(ts=2, ip_src="10.0.0.1", ip6_src="fd00::1", ip_dst="10.0.0.2", ip6_dst="2600::1")])
    assert {(r.ip_src, r.ip_dst) for r in p.collect()} == {("fd00::1", "2600::1"), ("10.0.0.1", "10.0.0.2")}


def test_bad_time_is_dropped_bad_length_is_zero(make):
    p = make([dict(ts="x"), dict(ts="1", len="??"), dict(ts="2", len="70")])
    assert sorted(r.len for r in p.collect()) == [0, 70]


def beat(n, step=60.0, dst="93.184.216.34", **kw):
    return [dict(ts=1000 + i * step, len=100, ip_src="10.0.0.5", ip_dst=dst, proto="UDP", udp_dport=4444, **kw) for i in range(n)]


@pytest.mark.parametrize("rows, fires", [
    (beat(16), True), (beat(15), False), (beat(16, dst="10.0.0.8"), False), (beat(16, 0.5), False),
    ([dict(r, udp_dport=123) for r in beat(16)], False)])
def test_beacon(make, rows, fires):
    got = E.beaconing(make(rows)).collect()
    assert bool(got) is fires
    if fires:
        assert got[0].score == 1.0 and got[0].severity == "high"


def test_beacon_across_slices_equals_one_slice(make):
    p = make(beat(200, 977.0))
    k = ["session_id", "ip_src", "ip_dst"]
    a = E.beacon_scores(p, k, slice_s=600.0).first()
    b = E.beacon_scores(p, k, slice_s=1e9).first()
    assert a == b and a.median_interval == 977.0


def test_arp_rules(make):
    arp = lambda ip, mac, op, ts: dict(ts=ts, arp_psrc=ip, arp_hwsrc=mac, arp_opcode=op)
    p = make([arp("192.168.1.1", "08:00:27:2d:f8:5a", 1, 1), arp("192.168.1.1", "08:00:27:5e:01:7c", 2, 2),
              arp("192.168.1.2", "aa:00:00:00:00:01", 1, 1), arp("192.168.1.2", "aa:00:00:00:00:02", 1, 1),
              arp("192.168.1.3", "ff:ff:ff:ff:ff:ff", 2, 1), arp("192.168.1.3", "aa:00:00:00:00:03", 1, 1)])
    got = {r.device: (round(r.score, 9), r.severity, r.peer) for r in E.arp_ip_multi_mac(p).collect()}
    assert got == {"192.168.1.1": (0.9, "high", "08:00:27:2d:f8:5a;08:00:27:5e:01:7c"),
                   "192.168.1.2": (0.5, "low", "aa:00:00:00:00:01;aa:00:00:00:00:02")}
    many = [arp(f"10.0.0.{i}", "bb:00:00:00:00:01", 1, i) for i in range(4)] + [arp(f"10.0.1.{i}", "bb:00:00:00:00:02", 1, i) for i in range(3)]
    assert [r.device for r in E.arp_mac_many_ips(make(many)).collect()] == ["bb:00:00:00:00:01"]


def test_dhcp(make):
    one = [dict(ts=1, dhcp_sid="10.0.0.1"), dict(ts=2, dhcp_sid="10.0.0.1")]
    assert E.rogue_dhcp(make(one)).count() == 0
    assert E.rogue_dhcp(make([*one, dict(ts=3, dhcp_sid="10.0.0.2")])).count() == 2


def test_tunnel(make):
    import hashlib
    ask = lambda i: dict(ts=i, ip_src="10.0.0.7", dns_qname=hashlib.md5(str(i).encode()).hexdigest() + ".evil.com", dns_response="0")
    got = E.dns_tunneling(make([ask(i) for i in range(20)])).collect()
    assert [(r.device, r.peer, r["count"]) for r in got] == [("10.0.0.7", "evil.com", 20)]
    assert E.dns_tunneling(make([ask(i) for i in range(19)])).count() == 0


def test_fusion_window_edges(spark):
    cols = "session_id string, device string, peer string, signal string, tactic string, technique string, score double, severity string, count bigint, first_ts double, last_ts double, detail string"
    row = lambda d, t, tech: ("S1", d, "", "s" + tech, "", tech, 0.4, "low", 1, t, t, "")
    df = spark.createDataFrame([row("a", 100.0, "T1"), row("a", 1000.0, "T2"), row("b", 100.0, "T1"), row("b", 1001.0, "T2")], cols)
    got = {r.device: r.risk for r in E.kill_chain_fusion(df).collect()}
    assert got == {"a": 0.6, "b": 0.4}


def test_same_session_has_no_churn(make):
    p = make([syn(f"10.0.0.{i}", "10.0.1.1", i) for i in range(9)])
    totals = K.source_bytes(p)
    twin = totals.unionByName(totals.withColumn("session_id", F.lit("S2")))
    assert K.churn_counts(K.session_compare(twin, "S1", "S2")).first() == (0, 0, 9)


def test_result_ignores_partitioning_and_order(make):
    rows = [syn(f"10.0.0.{i % 7}", f"198.51.100.{i % 40}", i, len=str(40 + i * 37 % 900)) for i in range(700)]
    key = lambda df: sorted(map(str, df.collect()))
    a = A.ip_features(make(rows).repartition(7)).select("ip", "count", "unique_dsts", F.round("std_len", 6))
    b = A.ip_features(make(rows[::-1]).coalesce(1)).select("ip", "count", "unique_dsts", F.round("std_len", 6))
    assert key(a) == key(b)
