"""Physical plan checks: no cartesian products or nested-loop joins, no Python UDFs, pushed filters."""

import pytest

from bidscope.catalog import all_entries
from conftest import SF001

QUERIES = {name: e.fn for name, e in all_entries().items()}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_latest_scan_filter_prunes_partitions(spark):
    from pyspark.sql import functions as F
    from bidscope.catalog import context as C

    df = C.obsn(spark, SF001).filter(F.col("scan_date") == F.lit("2001-10-01").cast("date")).select("title")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scan_date" in text
    assert "ReadSchema: struct<title:string>" in text


def test_state_aggregates_partially_before_shuffle(spark):
    from bidscope.catalog import context as C

    plan = _plan(C.state(spark, SF001))
    # map-side partial aggregation of max_by/min_by before the exchange on the entity key
    assert "partial_max_by" in plan and "partial_min_by" in plan


def test_lag_segments_include_sequence_block(spark):
    from bidscope.catalog import context as C
    from bidscope.operators.history import detect_changes

    plan = detect_changes(C.obsn(spark, SF001), "p_partkey")._jdf.queryExecution().optimizedPlan().toString()
    assert "_blk" in plan and "shiftright(obs_seq" in plan


def test_resolver_keys_are_null_for_blank_values(spark):
    from bidscope.operators.resolve import key_rows

    df = spark.createDataFrame([("", "", "T", "KL", "", 1), (None, None, "T", "KL", None, 2)], "listing_id string, header_full string, title string, location string, size string, obs_seq long")
    blank, missing = key_rows(df).orderBy("seq").collect()
    assert blank["lid"] is None and blank["home"] is None and blank["addr"] == b"" and blank["size"] == "" and blank["sk"] == missing["sk"]
    assert missing["lid"] is None and missing["home"] is None and missing["addr"] is None and missing["size"] is None
