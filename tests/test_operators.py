import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablight.operators import aggregates as A
from tablight.operators import cluster as C
from tablight.operators import joins as J
from tablight.operators import kpi as KP
from tablight.operators import profile as P
from tablight.operators import relational as R
from tablight.operators import roles as V
from tablight.operators import series as FS
from tablight.sources import coerce as SC
from tablight.sources import files


def test_profile_types_and_identifiers(spark):
    pdf = pd.DataFrame({"student_id": range(60), "name": [f"n{i}" for i in range(60)],
                        "flag": [0, 1] * 30, "grade": [float(i % 20) for i in range(60)],
                        "team": ["a", "b", "c"] * 20, "when": pd.date_range("2024-01-01", periods=60)})
    p = {r["column"]: r for r in P.profile(spark.createDataFrame(pdf)).collect()}
    assert p["student_id"]["is_identifier"] and p["name"]["is_identifier"]
    assert p["flag"]["type"] == "boolean" and p["when"]["type"] == "datetime"
    assert p["team"]["type"] == "categorical" and p["grade"]["type"] == "continuous_numeric"
    assert p["grade"]["median"] == np.median(pdf.grade)


def test_kpi_name_rules_fixture_sums(spark):
    df = spark.createDataFrame([(10, 20, 3, 4, 30), (20, 30, 2, 3, 40), (30, 40, 1, 2, 50)],
                               "revenue int, sales int, goals int, assists int, touches int")
    vals = {r["column"]: r for r in KP.kpi_values(df, df.columns).collect()}
    assert all(v["aggregation"] == "sum" for v in vals.values()) and vals["touches"]["value"] == 120


def test_kpi_plan_repairs_grades_to_mean(spark):
    df = spark.createDataFrame([(70, 4.0, 90, 60), (80, 4.5, 80, 70), (90, 5.0, 85, 80)],
                               "grades int, rating double, attendance int, score int")
    prof = P.profile(df)
    defs = spark.createDataFrame([(c, "supporting_metric", None, "sum", None, "high", True, False)
                                  for c in df.columns],
                                 "column string, role string, semantic_type string, aggregation string, "
                                 "direction string, confidence string, include_as_kpi boolean, "
                                 "include_in_clustering boolean")
    audit = V.audit_metrics(defs, prof).withColumn("ord", F.monotonically_increasing_id())
    assert {r["column"]: r["aggregation"] for r in audit.collect()} == dict.fromkeys(df.columns, "mean")
    kpis = {r["column"]: r["value"] for r in KP.plan_kpis(df, audit).collect()}
    assert kpis["grades"] == 80


def test_metric_audit_rejections(spark):
    df = spark.createDataFrame([(1, "ann", "f", 70, 90, 3, 100, 20), (2, "bob", "m", 80, 80, 4, 150, 30)],
                               "student_id int, student_name string, gender string, grades int, "
                               "attendance int, attendance_count int, revenue int, cost int")
    prof = P.profile(df)
    rows = [("student_name", "outcome_metric", "sum"), ("student_id", "supporting_metric", "sum"),
            ("made_up", "supporting_metric", "sum"), ("attendance", "supporting_metric", "sum"),
            ("attendance_count", "supporting_metric", "sum"), ("cost", "supporting_metric", "sum")]
    defs = spark.createDataFrame([(c, r, None, a, None, "high", True, True) for c, r, a in rows],
                                 "column string, role string, semantic_type string, aggregation string, "
                                 "direction string, confidence string, include_as_kpi boolean, "
                                 "include_in_clustering boolean")
    out = {r["column"]: r for r in V.audit_metrics(defs, prof).collect()}
    assert out["student_name"]["repair_reason"] == "non_numeric_metric"
    assert out["student_id"]["repair_reason"] == "id_like_metric"
    assert out["made_up"]["repair_reason"] == "column_not_found"
    assert out["attendance"]["aggregation"] == "mean" and out["attendance_count"]["aggregation"] == "sum"
    assert out["cost"]["direction"] == "lower_is_better"
    assert sum(r["validation_status"] == "rejected" for r in out.values()) == 3


def test_histogram_constant_column_and_bins(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    h = A.histogram(df, "x").collect()
    assert len(h) == 15 and sum(r["count"] for r in h) == 4 and h[0]["range"] == "4.5"
    rng = np.random.default_rng(1)
    v = rng.exponential(1, 100)
    got = [r["count"] for r in A.histogram(spark.createDataFrame([(float(x),) for x in v], "x double"), "x").collect()]
    assert got == list(np.histogram(v, bins=15)[0])


def test_pie_falls_back_for_ten_categories(spark):
    df = spark.createDataFrame([(f"t{i}", i + 1) for i in range(10)], "team string, goals int")
    assert A.pie(df, "goals", "team", "sum").count() == 0
    assert A.bar(df, "goals", "team", "sum").count() == 5


def test_trend_keeps_empty_months_as_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5), 1.0), (dt.datetime(2024, 3, 5), 3.0)], "d timestamp, v double")
    out = A.trend(df, "d", "v").collect()
    assert [(r["period"], r["v"]) for r in out] == [("2024-01-31", 1.0), ("2024-02-29", 0.0), ("2024-03-31", 3.0)]


def test_holt_continues_an_exact_line(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1), float(10 + 5 * m)) for m in range(1, 13)], "d date, y double")
    ser = FS.series(df, "d", ["y"], freq="month")
    h = FS.holt(ser, 3).collect()[0]
    assert np.allclose(h["forecast"], [75.0, 80.0, 85.0])
    fit = FS.trend_fit(ser).collect()[0]
    assert math.isclose(fit["slope"], 5.0) and math.isclose(fit["r2"], 1.0)
    bt = FS.backtest(ser).collect()[0]
    assert bt["holdout_points"] == 2 and bt["mae"] == 0.0


def test_direction_rules(spark):
    df = spark.createDataFrame([("up", i, 100.0 + 5 * i) for i in range(6)] +
                               [("flat", i, 100.0) for i in range(6)], "s string, i int, v double")
    got = {r["s"]: r["direction"] for r in FS.direction(df, ["s"], "i", "v").collect()}
    assert got == {"up": "upward", "flat": "stable"}


def test_join_safety_and_auto_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "Cust_ID long, a string")
    b = spark.createDataFrame([(1, 10), (1, 11)], "`cust id` long, b int")
    with pytest.raises(ValueError):
        J.auto_join([a, b])
    b2 = spark.createDataFrame([(1, 10), (None, 12)], "`cust id` long, b int")
    out = J.auto_join([a, b2]).orderBy("a").collect()
    assert [r["b"] for r in out] == [10, 10, 12]  # nulls match nulls, as in pandas


def test_fuzzy_match_columns():
    pairs = J.match_columns(["o_orderkey", "o_custkey"], ["c_custkey", "c_name"])
    assert ("o_custkey", "c_custkey") in [(a, b) for a, b, _ in pairs]


def test_csv_sniff_and_coerce(spark, tmp_path):
    p = tmp_path / "sample.csv"
    p.write_text("Date;Region;Sales;Profit;Order ID\n2024-01-01;North;1,5;3;7\n2024-01-02;South;2,5;4;8\n")
    df = files.read_csv(spark, str(p))
    assert df.columns == ["Date", "Region", "Sales", "Profit", "Order ID"]
    c = SC.coerce(df)
    types = dict(c.dtypes)
    assert types["Sales"] == "double" and types["Order ID"] == "string"
    assert [r["Sales"] for r in c.collect()] == [1.5, 2.5]


def test_retain_per_key(spark):
    base = dt.datetime(2024, 1, 2)
    rows = [("a", i, base - dt.timedelta(hours=i)) for i in range(40)] + [("b", 100, base)]
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp")
    out = R.retain(df, "ts", 24, 15, by=["k"], key="id").collect()
    assert sum(r["k"] == "a" for r in out) == 15 and sum(r["k"] == "b" for r in out) == 1


def test_kmeans_blobs_invariants(spark):
    rng = np.random.default_rng(42)
    pts = np.vstack([rng.normal(0, 0.5, (60, 2)), rng.normal(5, 0.5, (60, 2))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["feature_a", "feature_b"]))
    res = C.cluster(df, ["feature_a", "feature_b"], n_init=3)
    sizes = res["sizes"].collect()
    assert sum(r["size"] for r in sizes) == 120 and res["k"] >= 2
    inert = [r["inertia"] for r in res["inertias"].orderBy("k").collect()]
    assert all(a >= b - 1e-9 for a, b in zip(inert, inert[1:]))
    assert res["davies_bouldin"].collect()[0]["davies_bouldin"] > 0


def test_analysis_audit(spark):
    df = spark.createDataFrame([(1, "a", 3.0, 4.0), (2, "b", 5.0, 6.0)], "customer_id int, region string, revenue double, cost double")
    prof = P.profile(df)
    defs = spark.createDataFrame([
        ("a1", "Bar", "revenue", "region", []),
        ("a2", "clusters", None, None, ["revenue", "cost", "customer_id", "region"]),
        ("a3", "pie", "region", "nope", []),
        ("a4", "heatmap", "revenue", "region", [])],
        "id string, analysis_type string, metric string, dimension string, features array<string>")
    out = {r["id"]: r for r in V.audit_analyses(defs, prof).collect()}
    assert out["a1"]["validation_status"] == "accepted" and out["a1"]["analysis_type"] == "bar"
    assert out["a2"]["analysis_type"] == "clustering" and out["a2"]["features"] == ["revenue", "cost"]
    assert "features_filtered" in out["a2"]["issues"]
    assert out["a3"]["validation_status"] == "rejected" and "metric_not_numeric" in out["a3"]["issues"]
    assert out["a4"]["validation_status"] == "rejected"


def test_read_json_array_and_lines(spark, tmp_path):
    arr = tmp_path / "arr.json"
    arr.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    lines = tmp_path / "lines.json"
    lines.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n{"a": 3, "b": "z"}\n')
    assert files.read_json(spark, str(arr)).count() == 2
    assert files.read_json(spark, str(lines)).count() == 3


def test_stream_windowed_means_match_batch(spark):
    from tablight.streaming.trends import run_to_table
    from tests.conftest import SF
    out = run_to_table(spark, SF, "events", "ts", "value", "1 day")
    batch = (spark.read.parquet(f"{SF}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("d"))
             .agg(F.count(F.lit(1)).alias("n")))
    assert sorted(r["n"] for r in out.collect()) == sorted(r["n"] for r in batch.collect())


def test_kmeans_every_row_nearest_its_centre(spark):
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal(0, 0.5, (50, 2)), rng.normal(4, 0.5, (50, 2)), rng.normal((0, 4), 0.5, (50, 2))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["a", "b"]))
    sc = C.standardise(df, ["a", "b"])
    inertias, centres = C.kmeans_sweep(sc, ["a", "b"], n_init=3)
    for k, ctr in centres.items():
        out = C.assign(sc, ["a", "b"], ctr).toPandas()
        X = out[["a", "b"]].to_numpy()
        d2 = ((X[:, None, :] - np.asarray(ctr)[None, :, :]) ** 2).sum(2)
        assert (d2.argmin(1) == out["cluster"].to_numpy()).all()
        inertia = d2.min(1).sum()
        reported = inertias.where(F.col("k") == k).first()["inertia"]
        assert math.isclose(inertia, reported, rel_tol=1e-6)
