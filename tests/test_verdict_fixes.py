"""Rows that earlier versions lost or read wrongly, and tails that did not end."""
import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablight.functions import tails
from tablight.operators import cluster as C
from tablight.operators import joins as J
from tablight.operators import kpi as KP
from tablight.operators import profile as P
from tablight.operators import series as FS
from tablight.operators import stats as S
from tablight.sources import coerce as SC
from tablight.sources import files as SF_
from tests.conftest import SF


def test_csv_late_latin1_byte(spark, tmp_path):
    lines = ["id,name"] + [f"{i},plain" for i in range(60)] + ["60,M\u00fcller"]
    (tmp_path / "a.csv").write_bytes("\n".join(lines).encode("latin-1"))
    got = SF_.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.where("id = 60").first()["name"] == "M\u00fcller"
    assert got.count() == len(got.collect()) == 61


def test_csv_stray_quote_keeps_rows(spark, tmp_path):
    lines = ["id,name"] + ['0,5" pipe'] + [f"{i},plain" for i in range(1, 61)]
    (tmp_path / "b.csv").write_text("\n".join(lines))
    got = SF_.read_csv(spark, str(tmp_path / "b.csv"))
    assert got.count() == len(got.collect()) == 61


def test_json_pretty_printed_object(spark, tmp_path):
    (tmp_path / "c.json").write_text('{\n  "a": 1,\n  "b": "x"\n}\n')
    assert [r.asDict() for r in SF_.read_json(spark, str(tmp_path / "c.json")).collect()] == [{"a": 1, "b": "x"}]


def test_type_suffixes_are_no_numbers(spark):
    df = spark.createDataFrame([("12D",), ("5F",), ("7d",), ("8",), ("9f",)], "x string")
    assert dict(SC.coerce(df).dtypes)["x"] == "string"
    df = spark.createDataFrame([("1,5",), (" -2e3 ",), (".5",), ("x",)], "x string")
    assert [r.x for r in SC.coerce(df).collect()] == [1.5, -2000.0, 0.5, None]


def test_few_dates_do_not_make_a_date_column(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 5, F.concat(F.lit("2020-01-0"), F.col("id") + 1))
                                  .otherwise("words").alias("note"))
    assert FS.date_column(df) is None
    df = spark.range(1000).select(F.when(F.col("id") < 500, F.date_add(F.lit("2020-01-01").cast("date"),
                                                                       F.col("id").cast("int")).cast("string"))
                                  .otherwise("words").alias("note"))
    assert FS.date_column(df) == "note"


def test_keyword_after_any_separator(spark):
    names = spark.createDataFrame([("Unit.Price",), ("a/cost",), ("Net(Revenue)",), ("xprice",)], "n string")
    got = {r[0]: r[1] for r in names.select("n", KP.domain_priority(F.col("n"))).collect()}
    assert got == {"Unit.Price": 1, "a/cost": 1, "Net(Revenue)": 1, "xprice": 0}


@pytest.mark.parametrize("n1, n2", [(3, 4), (5, 5), (2, 7)])
def test_exact_mann_whitney_by_enumeration(n1, n2):
    every = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        assert tails._mwu_exact_sf(u, n1, n2) == pytest.approx(sum(x >= u for x in every) / len(every))


def test_exact_mann_whitney_with_a_rare_group_ends():
    t = time.time()
    p = tails.mann_whitney_p(4.2e6, 5, 1_000_000, 0.0, True)
    z = (4.2e6 - 2.5e6) / math.sqrt(5e6 * 1_000_006 / 12)
    assert time.time() - t < 20 and p == pytest.approx(2 * tails.norm_sf(z), rel=0.6)


def test_shapiro_sample_keeps_weights(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 10 < 9, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = S.shapiro(df, ["x"]).first()
    rng = np.random.default_rng(0)
    x = df.toPandas()["x"].to_numpy()
    w = [S.shapiro_wilk(rng.choice(x, 500, replace=False))[0] for _ in range(20)]
    assert abs(got["w"] - np.mean(w)) < 5 * np.std(w) + 0.02


def test_column_matching_is_one_to_one(spark):
    got = J.match_columns(["order_id", "order_date"], ["orderid", "date", "order_ids"])
    assert len({a for a, _, _ in got}) == len(got) == len({b for _, b, _ in got})
    assert J.match_columns([], ["a"]) == []


def test_profile_of_large_integers_and_nan(spark):
    df = spark.range(1000).select((F.col("id") + (1 << 60)).alias("big"),
                                  (F.col("id") + (1 << 60)).cast("decimal(25,0)").alias("dec"),
                                  F.when(F.col("id") % 4 == 2, float("nan")).otherwise(F.col("id") % 5).alias("x"))
    got = {r["column"]: r for r in P.profile(df).collect()}
    assert got["big"]["nunique"] == got["dec"]["nunique"] == 1000
    assert got["x"]["nunique"] == 5 and got["x"]["missing_ratio"] == pytest.approx(0.25)
    assert math.isfinite(got["x"]["mean"]) and got["x"]["max"] == 4.0


def test_contingency_with_many_levels_and_empty_cells(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 40, 600) // rng.integers(1, 9, 600), "b": rng.integers(0, 25, 600)})
    got = S.chi_square(spark.createDataFrame(pdf), "a", "b").first()
    o = pd.crosstab(pdf["a"], pdf["b"]).to_numpy().astype(float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert math.isclose(got["chi2"], ((o - e) ** 2 / e).sum(), rel_tol=1e-9)
    assert math.isclose(got["expected_min"], e.min(), rel_tol=1e-12)
    assert math.isclose(got["sparse_cell_ratio"], (e < 5).mean(), rel_tol=1e-12)
    assert (got["r"], got["c"], got["sample_size"]) == (*o.shape, 600)


def test_contingency_does_not_pair_all_levels(spark):
    # 3000 x 3000 levels, 3000 cells
    df = spark.range(3000).select(F.col("id").cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    got = S.chi_square(df, "a", "b").first()
    assert math.isclose(got["chi2"], 3000 * 2999, rel_tol=1e-9) and got["sparse_cell_ratio"] == 1.0


def test_contingency_with_one_level_is_no_test(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string")
    assert S.chi_square(df, "a", "b").count() == 0


def test_spearman_with_a_value_in_most_rows(spark):
    rng = np.random.default_rng(5)
    a = np.where(rng.random(2000) < 0.9, 0.0, rng.normal(size=2000))
    b = a + np.where(rng.random(2000) < 0.5, 0.0, rng.normal(size=2000))
    pdf = pd.DataFrame({"a": a, "b": b, "c": rng.normal(size=2000)})
    got = {(r["col_a"], r["col_b"]): r["r"] for r in S.spearman_matrix(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    want = pdf.corr("spearman")
    assert len(got) == 3 and all(math.isclose(v, want.loc[x, y], abs_tol=1e-9) for (x, y), v in got.items())


def test_kmeans_on_repeated_points_is_as_good_as_mllib(spark):
    # with the default ten restarts; with three, either engine may be about 1 % behind
    df = C.standardise(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_quantity", "l_discount"])
    ours = {r["k"]: r["inertia"] for r in C.kmeans_sweep(df, ["l_quantity", "l_discount"])[0].collect()}
    theirs = {r["k"]: r["inertia"] for r in
              C.kmeans_sweep(df, ["l_quantity", "l_discount"], engine="mllib")[0].collect()}
    assert set(ours) == set(theirs) == {2, 3, 4, 5}
    assert all(ours[k] <= 1.001 * theirs[k] for k in ours)


def test_kmeans_seed_weights_estimate_the_rows(spark):
    pts = spark.range(5000).select(F.col("id").cast("double").alias("x0"), F.when(F.col("id") < 10, 1000).otherwise(1).alias("w"))
    x, w = C._spread_points(pts, 1, 6, 64, 42)  # every row counts with its nearest candidate
    assert len(x) == len(w) <= 6 * 64 and w.sum() == 14990
    near = w[np.abs(x[:, 0] - 4.5) < 40].sum()
    assert near >= 10_000


def test_chart_rules_look_at_identifiers_and_flags(spark):
    from tablight.operators import aggregates as A
    rows = [(i, f"name {i}", "ab"[i % 2], i % 2, float(i), 0.5 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "order_key long, title string, region string, flag int, sales double, rate double")
    got = {(r["dimension"], r["metric"]): r["reason"] for r in A.part_to_whole_pairs(df).collect()}
    assert got[("region", "sales")] is None
    assert got[("region", "order_key")] == "identifier_metric"
    assert got[("region", "rate")] == "average_not_part_to_whole"
    assert "identifier_dimension" in got[("title", "sales")]
    typed = A.part_to_whole_pairs(df, {"sales": "score"}).where("metric = 'sales' and dimension = 'region'").first()
    assert typed["reason"] == "average_not_part_to_whole"
    assert A.pie(df, "sales", "region", "sum").count() == 2
    assert A.pie(df, "order_key", "region", "sum").count() == 0
    assert A.count_pie(df, "title").count() == 0
    assert A.scatter(df, "sales", "rate", "order_key").count() == 60
    assert A.scatter(df, "sales", "flag", "order_key").count() == 0
    assert A.scatter(df, "sales", "region", "order_key").count() == 0


def test_best_two_tests_of_each_category(spark):
    from tablight.operators import stats as S
    tests = spark.createDataFrame(
        [("c", "m1", 0.2), ("c", "m3", 0.01), ("c", "m2", 0.01), ("d", "m1", None), ("d", "m2", 0.5), ("d", "m0", None)],
        "categorical_col string, numeric_col string, q_value double")
    got = sorted((r[0], r[1]) for r in S.best_per_category(tests).select("categorical_col", "numeric_col").collect())
    assert got == [("c", "m2"), ("c", "m3"), ("d", "m0"), ("d", "m2")]


def test_audits_take_counts_second_metrics_and_probabilities(spark):
    from tablight.operators import profile as P
    from tablight.operators import roles as V
    df = spark.createDataFrame([("a", 3.0, 4.0), ("b", 5.0, 6.0)], "region string, revenue double, cost double")
    prof = P.profile(df)
    defs = spark.createDataFrame(
        [("count", "bar", "count", None, None, "region"), ("sum", "bar", "total", None, None, "region"),
         ("pair", "scatter", None, "revenue", "cost", None), ("half", "scatter", None, "revenue", None, None),
         ("odd", "scatter", None, "revenue", "region", None)],
        "id string, analysis_type string, aggregation string, metric string, second_metric string, dimension string"
    ).selectExpr("*", "cast(array() as array<string>) as features")
    out = {r["id"]: r for r in V.audit_analyses(defs, prof).collect()}
    assert out["count"]["validation_status"] == "accepted" and out["pair"]["validation_status"] == "accepted"
    assert out["sum"]["issues"] == ["aggregation_normalized", "metric_required"] and out["sum"]["aggregation"] == "sum"
    assert "second_metric_required" in out["half"]["issues"] and "second_metric_not_numeric" in out["odd"]["issues"]
    metrics = spark.createDataFrame(
        [("revenue", "0.8", "sum"), ("cost", "0.1", None), ("region", "0.5", "sum")],
        "column string, confidence string, aggregation string").selectExpr(
        "*", "'supporting_metric' role", "'money' semantic_type", "'neutral' direction", "true include_as_kpi",
        "true include_in_clustering")
    got = {r["column"]: r for r in V.audit_metrics(metrics, prof).collect()}
    assert got["revenue"]["repair_reason"].startswith("confidence_normalized")
    assert got["revenue"]["aggregation_source"] == "ai_validated"
    assert got["cost"]["aggregation_source"] == "backend_inferred"
    assert got["region"]["aggregation_source"] is None
