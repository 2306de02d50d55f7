from pyspark.sql import DataFrame

from tablight.plans import flows
from tests.conftest import SF


def _materialise(obj):
    if isinstance(obj, DataFrame):
        return obj.collect()
    if isinstance(obj, dict):
        return {k: _materialise(v) for k, v in obj.items()}
    return obj


def test_dashboard_and_analytics_on_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    dash = _materialise(flows.dashboard(orders, key="o_orderkey"))
    assert dash["kpis"] and dash["group_summary"] and dash["trends"]
    adv = _materialise(flows.analytics(orders))
    assert adv["group_tests"] and adv["insights"]


def test_forecast_and_clusters(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    fc = _materialise(flows.forecast(events))
    assert fc["series"] and fc["holt"]
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount",
                                                              "l_returnflag")
    res = flows.clusters(li, ["l_quantity", "l_extendedprice", "l_discount"])
    prof = res["profile"].collect()
    assert res["k"] in (3, 4) and len(prof) == res["k"]
    assert all(1 <= r["l_quantity"] <= 50 for r in prof)  # original units, not z-scores


def test_ingest_csv_and_parquet(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("order_id,amount\n1,10,5\n2,20,5\n".replace(",5\n", "\n"))
    out = flows.ingest(spark, [str(p)], save_to=str(tmp_path / "out"))
    assert dict(out.dtypes)["order_id"] == "string" and out.count() == 2
