"""Property tests on random, tie-heavy inputs (few examples: each runs Spark jobs)."""
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablight.functions.ordering import midranks
from tablight.operators import stats as S

_SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@_SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 6)), min_size=1, max_size=80),
       st.integers(1, 9))
def test_midranks_equal_pandas_average_ranks(spark, rows, buckets):
    pdf = pd.DataFrame(rows, columns=["g", "v"]).astype({"v": float})
    got = (midranks(spark.createDataFrame(pdf), ["g"], "v", n_buckets=buckets).toPandas()
           .set_index(["g", "v"])["rank"].sort_index())
    want = pdf.assign(r=pdf.groupby("g")["v"].rank(method="average")).groupby(["g", "v"])["r"].first().sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())


@_SETTINGS
@given(st.lists(st.floats(0, 1, allow_nan=False), min_size=1, max_size=30))
def test_bh_matches_step_up_formula(spark, ps):
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "id int, p double")
    got = dict((r["id"], r["q_value"]) for r in S.bh(df, "p", []).collect())
    m = len(ps)
    order = np.argsort(ps, kind="stable")
    adj = np.array(ps)[order] * m / np.arange(1, m + 1)
    q = np.minimum(1.0, np.minimum.accumulate(adj[::-1])[::-1])
    want = dict(zip(order.tolist(), q.tolist()))
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(m))
