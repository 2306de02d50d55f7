import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablight.functions.ordering import exact_quantiles, midranks, row_index, top_k_per_group


def _frame(spark, parts):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 600, p=[0.6, 0.3, 0.1]),
                        "v": rng.integers(0, 40, 600).astype(float), "k": np.arange(600)})
    return pdf, spark.createDataFrame(pdf).repartition(parts)


def test_midranks_match_pandas_at_any_partitioning(spark):
    for parts, buckets in ((1, 1), (4, 4), (7, 16)):
        pdf, df = _frame(spark, parts)
        got = midranks(df, ["g"], "v", n_buckets=buckets).toPandas().set_index(["g", "v"])["rank"]
        want = pdf.assign(r=pdf.groupby("g")["v"].rank(method="average")).groupby(["g", "v"])["r"].first()
        assert np.allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy())


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _frame(spark, 5)
    got = exact_quantiles(df, ["g"], "v", {"q1": .25, "med": .5, "q3": .75}).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        assert np.isclose(got.loc[g, "q1"], np.quantile(sub.v, .25))
        assert np.isclose(got.loc[g, "med"], np.median(sub.v))
        assert np.isclose(got.loc[g, "q3"], np.quantile(sub.v, .75))


def test_row_index_is_dense_and_ordered(spark):
    pdf, df = _frame(spark, 6)
    out = row_index(df, [], ["v", "k"], n_buckets=8).toPandas()
    assert sorted(out["_rn"]) == list(range(600))
    assert (out.sort_values("_rn")[["v", "k"]].to_numpy() == pdf.sort_values(["v", "k"])[["v", "k"]].to_numpy()).all()


def test_row_index_by_ranges_of_any_keys(spark):
    rng = np.random.default_rng(11)
    rows = [(None if i % 50 == 0 else "xyz"[i % 3], None if i % 7 == 0 else f"k{int(rng.integers(0, 30))}", i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, s string, i long").repartition(5)
    got = {r["i"]: (r["_rn"], r["_n"]) for r in row_index(df, ["g"], ["s", "i"]).collect()}
    assert len(got) == 800
    for g in (None, "x", "y", "z"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        assert [got[r[2]] for r in mine] == [(k, len(mine)) for k in range(len(mine))]


def test_top_k_per_group_exact(spark):
    pdf, df = _frame(spark, 6)
    got = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("k")], 3, ["k"], n_salt=5).toPandas()
    want = pdf.sort_values(["g", "v", "k"], ascending=[True, False, True]).groupby("g").head(3)
    assert sorted(map(tuple, got[["g", "k"]].to_numpy())) == sorted(map(tuple, want[["g", "k"]].to_numpy()))


def test_two_level_buckets_give_same_ranks(spark):
    pdf, df = _frame(spark, 5)
    a = midranks(df, ["g"], "v", n_buckets=4).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    b = midranks(df, ["g"], "v", n_buckets=5000).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    assert np.allclose(a["rank"], b["rank"]) and (a["cnt"] == b["cnt"]).all()
    q = exact_quantiles(df, ["g"], "v", {"med": .5}, n_buckets=70000).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        assert np.isclose(q.loc[g, "med"], np.median(sub.v))
