"""Plans: filters and column lists reach the scan, no nested loops, distinct counts spread over the pairs."""

import pytest

import __spark_entry__ as entry
from conftest import SF


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "a06_dns_response_sizes")
    assert "EqualTo(udp_sport,53)" in text and "IsNotNull(ip_src)" in text, text
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.count(":") <= 5 and "tls_sni" not in schema


@pytest.mark.parametrize("name", ["a01_ip_features", "d01_scan_alerts", "d09_external_inventory", "j04_cidr_provider", "j09_name_devices",
                                  "j10_telemetry_match", "w01_inter_arrival", "v08_panel_resolve", "m01_standardize"])
def test_no_nested_loops_and_no_row_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_scan_alerts_add_no_shuffle_to_the_features(spark):
    count = lambda n: plan(spark, n).count("Exchange hashpartitioning")
    assert count("d01_scan_alerts") == count("a01_ip_features")


def test_distinct_targets_are_combined_by_pair_first(spark):
    text = plan(spark, "a01_ip_features")
    assert "hashpartitioning(session_id" in text.replace("`", "") and "ip_dst" in text.split("Exchange hashpartitioning")[-1].split("\n")[0]


def test_what_several_blocks_of_a_record_read_is_made_once(spark):
    from catalog.verdicts import _candidates

    _, scored, scan, amp, arp, _ = _candidates(spark, SF)
    for df in (scored, scan, amp, arp):
        assert "parquet" not in df._jdf.queryExecution().executedPlan().toString().lower()
