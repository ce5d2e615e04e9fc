"""The driver's entry points, and plans that must stay native and narrow."""

import os

import pytest

import __spark_entry__
from leadspark.plans import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@needs_data
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["domain", "seed_url", "hits"] and 0 < df.count() <= 20


def test_registration():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(catalog.queries()) > 50


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["url_canonical", "discover_collapse", "discover_topk", "challenge_decision", "robots_allowed", "pack_budget", "lead_score", "lead_validate", "run_counters", "token_bucket_schedule", "rolling_ratio_alarm", "upsert_partial", "phone_e164"])
def test_native(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert not any(w in text for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


@needs_data
def test_scans_are_narrow(spark):
    text = plan(catalog.queries()["discover_topk"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text and "TakeOrderedAndProject" in text
    text = plan(catalog.queries()["list_events"](spark, SF))
    assert "PushedFilters: [IsNotNull(user_id)" in text and "TakeOrderedAndProject" in text
