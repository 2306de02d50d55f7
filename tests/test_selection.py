"""Positions and quantiles without an order of the rows, and mergeable profiles."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablight.functions import selection
from tablight.operators import profile as P
from tests.conftest import SF


def frame(spark, seed=1):
    rng = np.random.default_rng(seed)
    g = rng.choice(["a", "b", "c"], 6000, p=[.7, .29, .01])
    v = np.where(rng.random(6000) < .4, 7.0, np.round(rng.gamma(1, 30, 6000), 1))
    return pd.DataFrame({"g": g, "v": v}), spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(5)


@pytest.mark.parametrize("direct", [10_000_000, 1000, 20])
def test_quantiles_equal_numpy(spark, direct):
    pdf, df = frame(spark)
    probs = {"q1": .25, "q2": .5, "q3": .75, "low": .013}
    got = {r["g"]: r for r in selection.quantiles(df, ["g"], "v", probs, direct=direct).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], p), abs=1e-12)


@pytest.mark.parametrize("direct", [10_000_000, 50])
def test_kth_counts(spark, direct):
    pdf, df = frame(spark, 2)
    n = F.col("n")
    got = selection.kth(df, ["g"], "v", {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1}, direct=direct).collect()
    assert len(got) == 9
    for r in got:
        v = np.sort(pdf["v"][pdf["g"] == r["g"]].to_numpy())
        k = {"first": 0, "mid": len(v) // 2, "last": len(v) - 1}[r["t"]]
        assert r["v"] == v[k] and r["below"] == (v < v[k]).sum() and r["equal"] == (v == v[k]).sum()


def test_many_groups(spark):
    df = spark.range(40_000).select((F.col("id") % 10_000).alias("g"), F.col("id").cast("double").alias("v"))
    got = selection.quantiles(df, ["g"], "v", {"m": .5})
    assert got.count() == 10_000
    assert got.where(F.col("m") != F.col("g") + 15_000).count() == 0


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(float("nan"),), (None,)], "v double")
    assert selection.quantiles(df, [], "v", {"m": .5}).first()["m"] == 4.0
    assert selection.quantiles(df.where("false"), [], "v", {"m": .5}).count() == 0


@pytest.mark.parametrize("direct", [10_000_000, 30])
def test_row_in_the_middle_by_several_keys(spark, direct):
    rng = np.random.default_rng(4)
    rows = [("xy"[i % 2], int(rng.integers(0, 3)), f"ä{'k' * int(rng.integers(0, 12))}{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, d long, k string").repartition(4)
    got = {r["g"]: (r["d"], r["k"]) for r in
           selection.row_at(df, ["g"], ["d", "k"], F.floor(F.col("n") / 3), direct=direct).collect()}
    for g in "xy":
        mine = sorted(((d, k) for x, d, k in rows if x == g), key=lambda r: (r[0], r[1].encode()))
        assert got[g] == mine[len(mine) // 3]


def test_plan_of_quantiles_orders_no_rows(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = selection.quantiles(li, ["l_returnflag"], "l_quantity", {"m": .5}, direct=10)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def close(a, b, tol):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= tol * max(1.0, abs(b)))


def test_profile_state_merges(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn(
        "gaps", F.when(F.col("l_orderkey") % 4 == 0, float("nan")).otherwise(F.col("l_tax")))
    parts = [li.where(F.col("l_linenumber") % 3 == k) for k in range(3)] + [li.where("false")]
    states = parts[0]
    states = None
    for p in parts:
        s = P.profile_state(p)
        states = s if states is None else states.unionByName(s)
    got = {r["column"]: r for r in P.profile_of_state(P.merge_states(states)).collect()}
    want = {r["column"]: r for r in P.profile(li).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        g = got[c]
        for exact in ("position", "n_rows", "non_null", "date_parsed", "bool_values", "min", "max", "is_numeric"):
            assert g[exact] == w[exact], (c, exact)
        for near in ("mean", "variance", "skewness", "kurtosis"):
            assert close(g[near], w[near], 1e-6), (c, near, g[near], w[near])
        assert abs(g["nunique"] - w["nunique"]) <= 0.05 * w["nunique"] + 1, c
        if w["is_numeric"]:
            span = (w["max"] - w["min"]) or 1.0
            assert all(abs(g[q] - w[q]) <= 0.03 * span for q in ("q1", "median", "q3")), c
    assert got["l_returnflag"]["top_count"] == want["l_returnflag"]["top_count"]
    assert got["gaps"]["non_null"] < got["gaps"]["n_rows"]


def test_approx_profile_shuffles_no_values(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    exact, near = P.profile(li).collect(), P.profile(li, approx=True).collect()
    assert [(r["column"], r["type"], r["is_identifier"]) for r in exact] == \
        [(r["column"], r["type"], r["is_identifier"]) for r in near]
    plan = P.profile_state(li)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
