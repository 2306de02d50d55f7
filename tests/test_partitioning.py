"""Results must not depend on how many partitions the shuffles use
(bucket counts of the distributed ranking follow that setting)."""
import pytest

from __spark_entry__ import queries
from tests.conftest import SF

NAMES = ["t01_shapiro", "t04_midranks", "a16_box", "k05_kpi_trend", "t07_kruskal", "p01_profile", "r12_retain",
         "a23_auto_summary", "s07_preview", "t08_posthoc", "c10_feature_ranking"]


def _run(spark, name, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = queries()[name](spark, SF)
        return sorted((tuple(r) for r in df.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", NAMES)
def test_same_result_at_1_and_16_partitions(spark, name):
    assert _run(spark, name, 1) == _run(spark, name, 16)
