"""Scale checks on physical plans: no cartesian products, pruned scans,
top-n per group limited before the exchange."""

import pytest

import __spark_entry__ as E

CHECKED = ["tfidf_l2", "cluster_keywords", "top_advisor_rows", "advisor_by_year", "item_table",
           "assemble_record", "pairwise_within", "kmeans_assign", "vector_cov", "resolve_links"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cartesian_product(spark, small_dir, name):
    plan = plan_of(E.queries()[name](spark, small_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_report_scan_is_pruned(spark, small_dir):
    plan = plan_of(E.queries()["top_advisor_rows"](spark, small_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp" in plan
    assert "o_totalprice" not in plan and "c_acctbal" not in plan


def test_keywords_limit_before_exchange(spark, small_dir):
    df = E.queries()["cluster_keywords"](spark, small_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
