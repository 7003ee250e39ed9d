"""Candidate records, session context and pair reports on small hand-made inputs."""

import pytest

from packetloom.operators import rules, scoring, verdicts
from packetloom.operators.features import ip_features, session_summary
from packetloom.plans import reports

V = "ip string, verdict string, category string, confidence double, vendor string, hostname string"


def test_pair_report_tells_gap_and_both_confidences(spark):
    one = spark.createDataFrame([("a", "benign", "benign_anomaly", 0.9, "Acme", None), ("b", "malicious", "port_scan", 0.7, None, "box"),
                                 ("c", "malicious", "dns_amp", 0.8, None, None), ("d", None, None, None, None, None)], V)
    two = spark.createDataFrame([("a", "malicious", "port_scan", 0.6, "Acme", "cam"), ("b", "malicious", "port_scan", 0.5, None, None),
                                 ("e", "suspicious", "dns_amp", 0.4, None, None), ("f", "benign", "benign_anomaly", 1.0, None, None),
                                 ("d", "benign", "benign_anomaly", 0.1, None, None)], V)
    captures = spark.createDataFrame([("S1", 100.0, 5), ("S2", 160.4, 6), ("S3", 0.0, 1)], "session_id string, t0 double, n_packets bigint")
    r = verdicts.pair_report(one, two, captures).first()
    assert (r.total_s1, r.total_s2, r.only_s1_total, r.only_s2_total, r.flip_total, r.unchanged, r.gap_seconds) == (4, 5, 1, 2, 1, 1, 60)
    assert r.counts_s1.asDict() == {"malicious": 2, "suspicious": 0, "benign": 1}
    assert [x.asDict() for x in r.flips] == [{"ip": "a", "from": "benign", "to": "malicious", "from_confidence": 0.9, "to_confidence": 0.6,
                                              "s2_category": "port_scan", "device": "Acme cam"}]
    assert r.category_flow == {"benign -> malicious": 1}
    assert [x.ip for x in r.only_s2] == ["e", "f"] and [x.ip for x in r.new_non_benign_s2] == ["e"]
    assert [x.ip for x in r.top_non_benign_s1] == ["c", "b"] and r.top_non_benign_s1[1].device == "box"
    assert r.capture_s2.n_packets == 6


def test_pair_report_shows_the_worst_of_many_and_counts_all(spark):
    rows = [(f"h{i:03d}", ("benign", "suspicious", "malicious")[i % 3], "port_scan", (i % 10) / 10, None, None) for i in range(90)]
    r = verdicts.pair_report(spark.createDataFrame(rows, V), spark.createDataFrame([], V)).first()
    want = sorted((x for x in rows if x[1] == "malicious"), key=lambda x: (-x[3], x[0]))[:20]
    assert [x.ip for x in r.only_s1] == [x[0] for x in want] and r.only_s1_total == 90
    assert r.flips == [] and r.only_s2 == [] and r.total_s2 == 0 and r.category_flow == {}


@pytest.fixture(scope="module")
def session(make):
    rows = [dict(ts=str(100 + i), ip_src=f"10.0.0.{1 + i % 3}", ip_dst="9.9.9.9", len="100", proto="UDP") for i in range(30)]
    rows += [dict(ts="104.5", ip_src="10.0.0.2", ip_dst="9.9.9.9", len="5000", proto="TCP", tcp_flags="0x0002"),
             dict(ts="104.6", ip_src="10.0.0.1", ip_dst="9.9.9.9", len="4999", proto="TCP"),
             dict(ts="107.5", ip_src="10.0.0.3", ip_dst="9.9.9.9", len="5000"), dict(ts="107.6", ip_src="10.0.0.1", ip_dst="9.9.9.9", len="5000"),
             dict(ts="129", ip_src="9.9.9.9", ip_dst="10.0.0.1", len="50", dns_rcode="3", dns_response="1")]
    return make(rows)


def test_flagged_bins_count_for_their_largest_source(spark, session):
    flagged = spark.createDataFrame([("S1", 4), ("S1", 7), ("S1", 400), ("S2", 4)], "session_id string, bin bigint")
    got = {r.ip: r.bin_flag_count for r in scoring.rate_flag_counts(session, flagged).collect()}
    assert got == {"10.0.0.2": 1, "10.0.0.1": 1}  # bin 4 holds .2 with 5100 bytes; in bin 7 .1 has 5000, more by name than .3 on a tie or not
    empty = spark.createDataFrame([], "session_id string, bin bigint")
    assert scoring.rate_flag_counts(session, empty).count() == 0


def _tables(session):
    feats = ip_features(session).selectExpr("*", "0.12344 as iso_score", "1.0D as iso_stability", "ip = '10.0.0.1' as anomaly", "0 as cluster")
    scan, amp, arp, flood = rules.scan_alerts(feats), rules.dns_amplification(session), rules.arp_spoofing(session), rules.syn_flood(session)
    return feats, scan, amp, arp, flood


def test_records_have_every_block_whatever_is_known(spark, session):
    feats, scan, amp, arp, flood = _tables(session)
    rate = spark.createDataFrame([("S1", "10.0.0.2", 3)], "session_id string, ip string, bin_flag_count bigint")
    ranked = verdicts.rank_candidates(verdicts.detector_reasons(feats, scan, amp, arp, rate), feats)
    traffic = spark.createDataFrame([("S1", "10.0.0.1", 100, 300)], "session_id string, ip string, bytes_in bigint, bytes_out bigint")
    history = spark.createDataFrame([("10.0.0.2", True)], "ip string, seen_before boolean")
    got = {r.candidate_id: r for r in verdicts.assemble_candidates(ranked, feats, scan, amp, arp, flood, session_summary(session),
                                                                   {"traffic": traffic, "baseline_history": history}, rate).collect()}
    assert set(got) == {"10.0.0.1", "10.0.0.2"}
    one, two = got["10.0.0.1"], got["10.0.0.2"]
    assert one.traffic.upload_ratio == 0.75 and two.traffic.upload_ratio is None
    assert two.ml_signals.lstm_bin_flag_count == 3 and one.ml_signals.lstm_bin_flag_count is None and "lstm" in two.trigger_reasons
    assert two.baseline_history.seen_before and one.baseline_history.seen_before is None
    assert one.device_context.category == "unknown" and one.advanced_signals.beaconing is None and one.websites.top_tls_sni is None
    assert one.session_context.iso_timestamp == "1970-01-01T00:01:40" and one.session_context.day_of_week == "Thu"
    assert one.ml_signals.iso_score == 0.1234 and one.rule_signals.flood_alerts == []
    assert all(name in one for name in verdicts.RECORD_BLOCKS)


def test_context_counts_all_hosts_and_shows_the_first(spark, session):
    feats, scan, amp, arp, flood = _tables(session)
    ranked = verdicts.rank_candidates(verdicts.detector_reasons(feats, scan, amp, arp), feats)
    r = reports.context_record(session, feats, ranked, scan, amp, arp, flood, shown=1).first()
    assert (r.n_flagged, r.n_not_flagged, r.n_capped, r.local_ips_count, r.external_ips_count) == (1, 3, 0, 3, 1)
    assert r.flagged_ip_ids == ["10.0.0.1"] and [h.ip for h in r.not_flagged_ips] == ["10.0.0.2"] and r.capped_details == []
    assert r.rules.dns_nxdomain == 1 and r.rules.scan_alerts_summary == [] and r.ml.dbscan_meaningful
    assert r.time_range == ["1970-01-01T00:01:40", "1970-01-01T00:02:09"] and r.top_protocols[0].proto == "UDP"
    hosts = reports.context_hosts(feats, ranked).orderBy("section", *reports.host_order()).collect()
    assert [(h.section, h.ip) for h in hosts] == [("flagged", "10.0.0.1"), ("not_flagged", "10.0.0.2"), ("not_flagged", "10.0.0.3"), ("not_flagged", "9.9.9.9")]


def test_whole_analysis_fills_records_and_context(spark, make):
    # A hundred even seconds; a large packet close to the end is beyond any threshold of the last twenty.
    rows = [dict(ts=str(i), ip_src=f"10.0.0.{1 + i % 3}", ip_dst="9.9.9.9", len="100") for i in range(100)]
    session = make([*rows, dict(ts="95.5", ip_src="10.0.0.2", ip_dst="9.9.9.9", len="90000")])
    oui = spark.createDataFrame([("001122", "Acme")], "prefix6 string, vendor string")
    out = reports.analyse(session, trees=5, oui=oui, bin_s=1.0)
    assert {"candidates", "context", "context_hosts"} <= set(out)
    assert out["context_hosts"].count() == 3 and out["context"].count() == 1
    flagged = [r.candidate_id for r in out["candidates"].where("ml_signals.lstm_bin_flag_count > 0").collect()]
    assert "10.0.0.2" in flagged
