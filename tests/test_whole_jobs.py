"""Registered queries over the whole job: all rows with their positions, all columns."""
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tablight.operators import profile as P
from tablight.operators import relational as R
from tests.conftest import SF
from tests.test_registry import _norm, con  # noqa: F401

WHOLE = ["r01_sort_positions", "r02_text_positions", "j01_whole_documents", "s01_csv_all_columns",
         "p08_cards_all_columns"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_job_matches_oracle(spark, con, name):  # noqa: F811
    df = queries()[name](spark, SF)
    res = con.execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), cols)


def test_positions_follow_the_sort(spark):
    rows = [(i, v) for i, v in enumerate([2.0, None, float("nan"), -1.0, 2.0, None, 0.0])]
    df = spark.createDataFrame(rows, "k long, v double")
    for desc, text in ((False, False), (True, False), (False, True)):
        want = [r.k for r in R.sort_rows(df, "v", desc, "k", text).collect()]
        got = R.sort_positions(df, "v", "k", desc, text).orderBy("position").collect()
        assert [r.k for r in got] == want and [r.position for r in got] == list(range(len(rows)))


def test_cards_of_all_columns(spark):
    wide = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(30)])
    assert P.column_cards(wide).count() == 30
