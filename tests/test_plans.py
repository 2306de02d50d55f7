"""Plan guards: keyed operators must not funnel data into one partition."""
from pyspark.sql import functions as F

from tablight.functions.ordering import exact_quantiles, midranks, top_k_per_group
from tablight.operators import relational as R
from tablight.operators import stats as S
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_ranking_has_no_single_partition_exchange(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plans = {
        "midranks": _plan(midranks(li, ["l_returnflag"], "l_extendedprice")),
        "quantiles": _plan(exact_quantiles(li, ["l_returnflag"], "l_extendedprice", {"m": .5})),
        "top_k": _plan(top_k_per_group(li, ["l_returnflag"], [F.col("l_extendedprice").desc(),
                                                              F.col("l_orderkey"), F.col("l_linenumber")], 3)),
        "retain": _plan(R.retain(spark.read.parquet(f"{SF}/events.parquet"), "ts", 24, 15,
                                 by=["event_type"], key="event_id")),
    }
    for name, plan in plans.items():
        assert "SinglePartition" not in plan, name


def test_group_tests_rank_per_family_not_globally(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    plan = _plan(S.group_tests(o, ["o_orderstatus"], ["o_totalprice"], posthoc=False))
    # the only single-partition steps allowed are over test tables (one row per test)
    assert "Window" in plan
    assert plan.count("hashpartitioning(categorical_col") > 0


def test_scan_prunes_columns_and_pushes_filters(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = _plan(R.drop_missing(li.where(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
