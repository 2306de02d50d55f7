"""The reference's evaluation scenarios (FIXTURES.md), rebuilt as seeded data."""
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablight.operators import cluster as C
from tablight.operators import series as FS
from tablight.operators import stats as S


def test_normal_scenario_shape_and_missing(spark):
    rng = np.random.default_rng(42)
    metric = rng.normal(100, 10, 160)
    metric[::53] = np.nan
    pdf = pd.DataFrame({"metric": metric, "related": metric * 0.5 + rng.normal(0, 1, 160)})
    df = spark.createDataFrame(pdf).withColumn("metric", F.when(F.isnan("metric"), None).otherwise(F.col("metric")))
    sw = S.shapiro(df, ["metric"])
    sh = S.shape(df, ["metric"], sw).collect()[0]
    assert sh["shape"] == "approximately_normal" and sh["is_normal"]
    meta = S.missing_meta(df, ["metric"]).collect()[0]
    assert meta["missing_dropped_count"] == 4 and meta["sample_size"] == 156


def test_monthly_scenario_forecast_quality(spark):
    rng = np.random.default_rng(42)
    dates = pd.date_range("2024-01-31", periods=24, freq="ME")
    sales = np.linspace(100, 220, 24) + rng.normal(0, 8, 24)
    df = spark.createDataFrame(pd.DataFrame({"date": dates, "sales": sales}))
    ser = FS.series(df, "date", ["sales"])
    assert ser.first()["freq"] == "month" and ser.count() == 24
    flags = FS.forecast_flags(ser).collect()[0]
    assert flags["holdout_points"] == 4 and flags["mae"] is not None and flags["mape"] < 30
    assert flags["warnings"] == []
    hw = FS.holt(ser, 6).collect()[0]
    assert len(hw["forecast"]) == 6 and hw["forecast"][-1] > hw["forecast"][0]


def test_customers_scenario_rankings_and_categories(spark):
    rng = np.random.default_rng(42)
    dept = np.repeat(["retail", "enterprise", "smb"], 40)
    base = {"retail": (200, 30, 0.30), "enterprise": (900, 10, 0.05), "smb": (400, 60, 0.15)}
    rows = []
    for i, d in enumerate(dept):
        amt, rec, churn = base[d]
        rows.append((f"c{i:03d}", str(d), float(rng.normal(amt, amt * 0.1)), float(rng.normal(rec, 3)),
                     float(np.clip(rng.normal(churn, 0.02), 0, 1))))
    df = spark.createDataFrame(rows, "customer_id string, department string, purchase_amount double, "
                                     "recency_days double, churn_rate double")
    res = C.cluster(df, ["purchase_amount", "recency_days", "churn_rate"], key="customer_id", n_init=3)
    assigned = res["assigned"]
    cats = C.top_categories(assigned, ["department"]).collect()
    assert {r["column"] for r in cats} == {"department"}
    original = assigned.select("cluster", *[F.col(f"{c}__raw").alias(c)
                                            for c in ["purchase_amount", "recency_days", "churn_rate"]])
    ranks = C.feature_ranking(original, ["purchase_amount", "recency_days", "churn_rate"]).collect()
    lib = {r["column"]: r["lower_is_better"] for r in ranks}
    assert lib["churn_rate"] and lib["recency_days"] and not lib["purchase_amount"]
