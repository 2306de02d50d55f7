"""NaN is missing for every operator, as a null is."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablight.functions.missing import without_nan
from tablight.operators import aggregates as A
from tablight.operators import kpi as KP
from tablight.operators import relational as R
from tablight.operators import series as FS
from tablight.operators import stats as S


@pytest.fixture(scope="module")
def both(spark):
    """The same table with NaN and with null in its gaps."""
    rng = np.random.default_rng(9)
    rows = [(i, f"2024-{1 + i % 9:02d}-{1 + i % 27:02d}", "abc"[i % 3], float("nan") if i % 7 == 0 else float(rng.normal(10, 3)),
             float(i)) for i in range(180)]
    nan = spark.createDataFrame(rows, "id long, day string, grp string, amount double, other double")
    return nan, without_nan(nan)


def rows(df):
    def plain(v):
        if isinstance(v, float):
            assert not math.isnan(v)
            return round(v, 9)
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    return sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)


CASES = {
    "k04": lambda d: KP.kpi_values(d, ["amount", "other"]),
    "k05": lambda d: KP.kpi_trend(d, "day", ["amount"], "id"),
    "a07": lambda d: A.trend(d, "day", "amount"),
    "a08": lambda d: A.run_plan(d, "bar", "grp", "amount", agg="sum"),
    "a14": lambda d: A.category_counts(d.select(F.round("amount", -1).alias("x")), "x"),
    "a16": lambda d: A.box(d, "grp", "amount"),
    "a23": lambda d: A.auto_summary(d, ["grp"], ["amount"]),
    "a25": lambda d: A.group_query(d, "grp", "amount"),
    "t03": lambda d: S.missing_meta(d, ["amount", "grp"]),
    "t05": lambda d: S.spearman_matrix(d, ["amount", "other"]),
    "t05 pairs": lambda d: S.spearman_matrix(d, ["amount", "other"], complete_rows=False),
    "t05 tests": lambda d: S.spearman_tests(d, ["amount", "other"]),
    "t06": lambda d: S.group_tests(d.where("grp <> 'c'"), ["grp"], ["amount"], posthoc=False),
    "t07": lambda d: S.group_tests(d, ["grp"], ["amount", "other"]),
    "t08": lambda d: S.posthoc_all(d, "grp", "amount"),
    "f03": lambda d: FS.series(d, "day", ["amount"], freq="month"),
    "r06": lambda d: R.drop_sparse_columns(d, 0.1),
    "r07": lambda d: R.fill_display(d),
    "r09": lambda d: R.nunique(d),
    "r11": lambda d: R.top_k(d, "amount", 5, "id"),
}


@pytest.mark.parametrize("name", CASES)
def test_nan_is_missing(both, name):
    nan, null = both
    got = rows(CASES[name](nan))
    assert got and got == rows(CASES[name](null))


def test_sorted_last_both_ways(both):
    nan, _ = both
    gaps = {r["id"] for r in nan.collect() if math.isnan(r["amount"])}
    for desc in (False, True):
        order = [r["id"] for r in R.sort_rows(nan, "amount", desc=desc, key="id").collect()]
        assert set(order[-len(gaps):]) == gaps
        at = {r["id"]: r["position"] for r in R.sort_positions(nan, "amount", "id", desc=desc).collect()}
        assert [at[i] for i in order] == list(range(len(order)))


def test_wins_and_medians_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 500
    value, level = np.round(rng.normal(0, 2, n), 1), rng.choice(list("pqrs"), n, p=[.5, .3, .19, .01])
    other = rng.choice(["u", "v", None], n)
    df = spark.createDataFrame([(float(v), str(x), None if y is None else str(y)) for v, x, y in zip(value, level, other)],
                               "v double, x string, y string")
    monkeypatch.setattr(S, "BLOCK", 7)
    for cat, names in (("x", level), ("y", other)):
        got = {(r["group_a"], r["group_b"]): r for r in S.posthoc_all(df, cat, "v", min_group=3).collect()}
        if cat == "y":
            assert not got  # two groups need no pairs
            continue
        for (a, b), r in got.items():
            x, y = value[names == a], value[names == b]
            assert r["u"] == sum((i > y).sum() + (i == y).sum() / 2 for i in x)
            assert r["median_diff"] == pytest.approx(np.median(x) - np.median(y))
        assert len(got) == sum(1 for i, a in enumerate("pqrs") for b in "pqrs"[i + 1:]
                               if min((names == a).sum(), (names == b).sum()) >= 3)


def test_too_many_levels(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("v"))
    with pytest.raises(ValueError, match="levels"):
        S.group_tests(df, ["c"], ["v"])


def test_retention_takes_the_newest_first(spark):
    df = spark.sql("""SELECT id, if(id % 11 = 0, null, id % 3) AS g,
        if(id % 13 = 0, null, timestamp'2024-01-10' - make_interval(0, 0, 0, 0, id % 97, 0, 0)) AS ts FROM range(600)""")
    got = {(r["g"], r["id"]) for r in R.retain(df, "ts", 24, 15, by=["g"], key="id").collect()}
    want = set()
    table = [r for r in df.collect() if r["g"] is not None and r["ts"] is not None]
    for g in (0, 1, 2):
        mine = sorted((r for r in table if r["g"] == g), key=lambda r: (r["ts"], r["id"]), reverse=True)
        want |= {(g, r["id"]) for r in mine if (mine[0]["ts"] - r["ts"]).total_seconds() <= 86400 and mine.index(r) < 15}
    assert got == want and len(want) > 20
    assert R.retain(df.where("false"), "ts", by=["g"]).count() == 0
