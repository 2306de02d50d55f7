"""Registered queries: one Spark DataFrame per operator over the test tables,
each paired (where SQL can express it) with an equivalent DuckDB query.

Every query reads whole tables (or frames Spark derives from them).  Money
sums run on ``decimal(18,2)`` on both sides so totals are exact and
order-free; other doubles are rounded to a fixed number of places on both
sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.functions.text import clean_text, clean_text_sql
from tablight.operators import aggregates as A
from tablight.operators import cluster as C
from tablight.operators import joins as J
from tablight.operators import kpi as KP
from tablight.operators import profile as P
from tablight.operators import relational as R
from tablight.operators import roles as V
from tablight.operators import series as FS
from tablight.operators import stats as S
from tablight.sources import coerce as SC

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def tbl(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rnd(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (both sides of the oracle do the same)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def money(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# Population skewness / excess kurtosis from moments (DuckDB's are bias-corrected).
def _skew_sql(x: str, t: str) -> str:
    return (f"(SELECT avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5) "
            f"FROM {t}, (SELECT avg({x}) m FROM {t}) WHERE {x} IS NOT NULL)")


# ==========================================================================
# A: grouped and chart aggregates
# ==========================================================================

@register("a01_bar_sum", """
SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice
FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY o_orderpriority ORDER BY 2 DESC, 1 LIMIT 5""")
def a01(spark, d):
    o = money(tbl(spark, d, "orders"), "o_totalprice")
    return as_double(A.bar(o, "o_totalprice", "o_orderpriority", "sum"), "o_totalprice")


@register("a02_count_bar", """
SELECT p_brand, COUNT(*) AS "count" FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 5""")
def a02(spark, d):
    return A.count_bar(tbl(spark, d, "part"), "p_brand")


@register("a03_pie_sum", """
SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice
FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY 1 HAVING (SELECT COUNT(DISTINCT o_orderstatus) FROM orders) BETWEEN 2 AND 8
ORDER BY 2 DESC, 1 LIMIT 8""")
def a03(spark, d):
    o = money(tbl(spark, d, "orders"), "o_totalprice")
    return as_double(A.pie(o, "o_totalprice", "o_orderstatus", "sum"), "o_totalprice")


@register("a04_count_pie", """
SELECT o_orderpriority, COUNT(*) AS "count" FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def a04(spark, d):
    return A.count_pie(tbl(spark, d, "orders"), "o_orderpriority")


@register("a05_share", """
WITH c AS (SELECT c_mktsegment, COUNT(*) AS "count" FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT c_mktsegment, "count",
       ROUND(CASE WHEN SUM("count") OVER () > 0 THEN "count" / SUM("count") OVER () ELSE 0 END, 6) AS share
FROM c""")
def a05(spark, d):
    c = tbl(spark, d, "customer").select("c_mktsegment").dropna().groupBy("c_mktsegment") \
        .agg(F.count(F.lit(1)).alias("count"))
    return rnd(A.share(c, "count"), 6)


@register("a06_line", """
SELECT o_orderdate, ROUND(AVG(o_totalprice), 4) AS o_totalprice FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY 1 ORDER BY 1 LIMIT 60""")
def a06(spark, d):
    return rnd(A.line(tbl(spark, d, "orders"), "o_totalprice", "o_orderdate", "mean"), 4)


@register("a07_trend_year", """
WITH b AS (SELECT date_trunc('year', o_orderdate) p, AVG(o_totalprice) m FROM orders
           WHERE o_orderdate IS NOT NULL GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT date_trunc('year', MIN(o_orderdate)) FROM orders),
                                      (SELECT date_trunc('year', MAX(o_orderdate)) FROM orders),
                                      INTERVAL 1 YEAR)) p)
SELECT strftime(make_date(year(cal.p), 12, 31), '%Y-%m-%d') AS period,
       ROUND(COALESCE(b.m, 0), 4) AS o_totalprice
FROM cal LEFT JOIN b ON cal.p = b.p""")
def a07y(spark, d):
    return rnd(A.trend(tbl(spark, d, "orders"), "o_orderdate", "o_totalprice"), 4)


@register("a07_trend_day", """
WITH b AS (SELECT date_trunc('day', ts) p, AVG(value) m FROM events WHERE ts IS NOT NULL GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT date_trunc('day', MIN(ts)) FROM events),
                                      (SELECT date_trunc('day', MAX(ts)) FROM events),
                                      INTERVAL 1 DAY)) p)
SELECT strftime(cal.p, '%Y-%m-%d') AS period, ROUND(COALESCE(b.m, 0), 4) AS value
FROM cal LEFT JOIN b ON cal.p = b.p""")
def a07d(spark, d):
    return rnd(A.trend(tbl(spark, d, "events"), "ts", "value"), 4)


@register("a08_run_plan_count", """
SELECT l_returnflag, COUNT(*) AS "count" FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 5""")
def a08(spark, d):
    return A.run_plan(tbl(spark, d, "lineitem"), "bar", "l_returnflag", agg="count")


@register("a08_run_plan_mean_line", """
SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate, ROUND(AVG(o_totalprice), 4) AS o_totalprice
FROM orders GROUP BY o_orderdate ORDER BY o_orderdate NULLS FIRST LIMIT 30""")
def a08b(spark, d):
    o = tbl(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return rnd(A.run_plan(o, "line", "o_orderdate", "o_totalprice", agg="mean"), 4)


@register("a10_scatter", """
SELECT o_orderkey AS __row, o_totalprice, o_custkey, o_orderpriority AS __label FROM orders
WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL ORDER BY o_orderkey LIMIT 300""")
def a10(spark, d):
    o = tbl(spark, d, "orders")
    return A.scatter(o, "o_totalprice", "o_custkey", "o_orderkey", "o_orderpriority")


@register("a11_table", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE NOT (o_orderstatus IS NULL AND o_totalprice IS NULL) ORDER BY o_orderkey LIMIT 30""")
def a11(spark, d):
    return A.table_extract(tbl(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_totalprice"])


_HIST_SQL = """
WITH mm AS (SELECT MIN(l_extendedprice) lo, MAX(l_extendedprice) hi FROM lineitem),
b AS (SELECT LEAST(CAST(FLOOR((l_extendedprice - lo) / ((hi - lo) / 15)) AS INTEGER), 14) AS bin, COUNT(*) c
      FROM lineitem, mm WHERE l_extendedprice IS NOT NULL GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(15))
SELECT bins.bin, printf('%.1f', lo + bins.bin * ((hi - lo) / 15)) AS "range", COALESCE(c, 0) AS "count"
FROM bins CROSS JOIN mm LEFT JOIN b ON bins.bin = b.bin"""


@register("a12_histogram", _HIST_SQL)
def a12(spark, d):
    return A.histogram(tbl(spark, d, "lineitem"), "l_extendedprice")


@register("a14_category_counts", """
SELECT o_orderpriority, COUNT(*) AS "count" FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def a14(spark, d):
    return A.category_counts(tbl(spark, d, "orders"), "o_orderpriority")


@register("a15_concentration", """
WITH c AS (SELECT p_brand, COUNT(*) c FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
t AS (SELECT SUM(c) top3 FROM (SELECT c FROM c ORDER BY c DESC, p_brand LIMIT 3))
SELECT CAST(top3 AS BIGINT) AS top3, CAST((SELECT SUM(c) FROM c) AS BIGINT) AS total,
       ROUND(top3 * 100.0 / (SELECT SUM(c) FROM c), 6) AS top3_pct,
       CASE WHEN top3 * 100.0 / (SELECT SUM(c) FROM c) > 70 THEN 'high'
            WHEN top3 * 100.0 / (SELECT SUM(c) FROM c) > 40 THEN 'medium' ELSE 'balanced' END AS band
FROM t""")
def a15(spark, d):
    return rnd(A.concentration(tbl(spark, d, "part"), "p_brand"), 6)


@register("a16_box", """
SELECT o_orderpriority AS "group", ROUND(MIN(o_totalprice), 4) AS "min",
       ROUND(quantile_cont(o_totalprice, 0.25), 4) AS q1, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS median,
       ROUND(quantile_cont(o_totalprice, 0.75), 4) AS q3, ROUND(MAX(o_totalprice), 4) AS "max", COUNT(*) AS n
FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL
GROUP BY 1 HAVING COUNT(*) >= 3 ORDER BY 1 LIMIT 10""")
def a16(spark, d):
    return rnd(A.box(tbl(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4)


@register("a17_mean_by", """
SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS c_acctbal FROM customer
WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL GROUP BY 1 ORDER BY AVG(c_acctbal) DESC, 1 LIMIT 5""")
def a17(spark, d):
    return rnd(A.mean_by(tbl(spark, d, "customer"), "c_mktsegment", "c_acctbal"), 4)


@register("a18_crosstab_pct", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS "count",
       ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY l_returnflag), 6) AS pct
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2""")
def a18(spark, d):
    return rnd(A.crosstab_pct(tbl(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 6)


def _rank_sql(t: str, cols: list[str]) -> str:
    """Mid-ranks of every column over rows complete in all of them."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols)
    return f"(SELECT {ranks} FROM {t} WHERE {complete})"


def _spearman_sql(t: str, cols: list[str]) -> str:
    parts = []
    k = 0
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            parts.append(f"SELECT '{cols[i]}' AS col_a, '{cols[j]}' AS col_b, {k} AS pair_pos, "
                         f"corr(r_{cols[i]}, r_{cols[j]}) AS r, COUNT(*) AS n FROM rk")
            k += 1
    return f"WITH rk AS {_rank_sql(t, cols)} " + " UNION ALL ".join(parts)


_LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a19_correlation_table", f"""
WITH m AS ({_spearman_sql("lineitem", _LI4)}),
t AS (SELECT col_a AS var_a, col_b AS var_b, ROUND(COALESCE(r, 0), 2) AS correlation, pair_pos FROM m)
SELECT var_a, var_b, correlation,
       CASE WHEN abs(correlation) >= 0.5 THEN 'strong' WHEN abs(correlation) >= 0.3 THEN 'moderate' ELSE 'weak' END
       AS strength
FROM t WHERE (SELECT MAX(abs(correlation)) FROM t) >= 0.5 ORDER BY abs(correlation) DESC, pair_pos LIMIT 12""")
def a19(spark, d):
    return A.correlation_table(tbl(spark, d, "lineitem"), _LI4)


@register("a20_scatter_pairs", f"""
WITH m AS ({_spearman_sql("lineitem", _LI4)})
SELECT col_a, col_b, pair_pos, ROUND(r, 6) AS r, n FROM m
WHERE abs(r) < 0.95 AND n >= 10 AND r IS NOT NULL ORDER BY abs(r) DESC, pair_pos LIMIT 3""")
def a20(spark, d):
    return rnd(S.scatter_pairs(tbl(spark, d, "lineitem"), _LI4), 6)


@register("a21_fit_line", f"""
WITH rk AS {_rank_sql("lineitem", ["l_quantity", "l_extendedprice"])}
SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       ROUND(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       ROUND(corr(l_quantity, l_extendedprice), 6) AS pearson_r,
       ROUND(MIN(l_quantity), 6) AS x_min, ROUND(MAX(l_quantity), 6) AS x_max, COUNT(*) AS n,
       ROUND((SELECT corr(r_l_quantity, r_l_extendedprice) FROM rk), 6) AS spearman_r,
       ROUND(power((SELECT corr(r_l_quantity, r_l_extendedprice) FROM rk), 2), 6) AS r2,
       ROUND(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * MIN(l_quantity), 4) AS y_at_min,
       ROUND(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * MAX(l_quantity), 4) AS y_at_max
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def a21(spark, d):
    f = A.fit_line(tbl(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return rnd(rnd(f, 6).withColumn("y_at_min", F.round("y_at_min", 4)).withColumn("y_at_max", F.round("y_at_max", 4)), 6)


@register("a22_nearby", """
WITH b AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) x, CAST(o_custkey AS DOUBLE) y FROM orders
           WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
r AS (SELECT MIN(x) x0, MAX(x) x1, MIN(y) y0, MAX(y) y1 FROM b),
dd AS (SELECT o_orderkey, x, y, abs((x - 250000) / greatest(x1 - x0, 1e-12)) AS dx,
              sqrt(power((x - 250000) / greatest(x1 - x0, 1e-12), 2) + power((y - 700) / greatest(y1 - y0, 1e-12), 2)) AS distance
       FROM b, r)
SELECT o_orderkey, x AS o_totalprice, y AS o_custkey, ROUND(distance, 8) AS distance FROM dd
WHERE distance <= 0.045 OR (dx < 0.002 AND distance <= 0.12) ORDER BY distance, o_orderkey LIMIT 10""")
def a22(spark, d):
    out = A.nearby(tbl(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey", 250000.0, 700.0)
    return out.withColumn("distance", F.round("distance", 8))


@register("a23_auto_summary", """
WITH l AS (SELECT 'o_orderstatus' AS dimension, CAST(o_orderstatus AS VARCHAR) AS level, o_totalprice v FROM orders
           UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), o_totalprice FROM orders),
g AS (SELECT dimension, level, 'o_totalprice' AS metric, 'mean' AS aggregation, AVG(v) AS value
      FROM l WHERE level IS NOT NULL GROUP BY 1, 2)
SELECT dimension, level, metric, aggregation, ROUND(value, 4) AS value,
       CAST(row_number() OVER (PARTITION BY dimension, metric ORDER BY value DESC, level) AS INTEGER) AS "rank"
FROM g WHERE value IS NOT NULL QUALIFY "rank" <= 5""")
def a23(spark, d):
    return rnd(A.auto_summary(tbl(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"],
                              aggs={"o_totalprice": "mean"}), 4)


@register("a24_density", """
WITH b AS (SELECT CAST(l_quantity AS DOUBLE) x, l_extendedprice y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT MIN(x) x0, MAX(x) x1, MIN(y) y0, MAX(y) y1 FROM b)
SELECT LEAST(CAST(FLOOR((x - x0) / (greatest(x1 - x0, 1e-12) / 10)) AS INTEGER), 9) AS x_bin,
       LEAST(CAST(FLOOR((y - y0) / (greatest(y1 - y0, 1e-12) / 10)) AS INTEGER), 9) AS y_bin,
       COUNT(*) AS "count"
FROM b, r GROUP BY 1, 2""")
def a24(spark, d):
    return A.density(tbl(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10, 10)


@register("a25_group_query_bottom", """
SELECT c_nationkey, ROUND(AVG(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1
HAVING AVG(c_acctbal) IS NOT NULL ORDER BY AVG(c_acctbal) ASC, 1 LIMIT 5""")
def a25(spark, d):
    return rnd(A.group_query(tbl(spark, d, "customer"), "c_nationkey", "c_acctbal", "bar", bottom=True, n=5), 4)


@register("a25_scatter_sample", """
SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL
AND o_orderkey IS NOT NULL ORDER BY o_orderkey LIMIT 100""")
def a25s(spark, d):
    return A.scatter_sample(tbl(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey")


# ==========================================================================
# R: relational basics
# ==========================================================================

@register("r01_sort_nulls_last", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price
FROM orders ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 20""")
def r01(spark, d):
    o = tbl(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, None)
                                       .otherwise(F.col("o_totalprice")).alias("price"))
    return R.sort_rows(o, "price", desc=True, key="o_orderkey").limit(20)


@register("r02_sort_as_text", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY CAST(o_totalprice AS VARCHAR), o_orderkey LIMIT 20""")
def r02(spark, d):
    # text order of the decimal form (both engines print doubles shortest-round-trip)
    o = money(tbl(spark, d, "orders"), "o_totalprice")
    return as_double(R.sort_rows(o, "o_totalprice", key="o_orderkey", as_text=True).limit(20)
                     .select("o_orderkey", "o_totalprice"), "o_totalprice")


@register("r01_sort_positions", """
SELECT *, row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) - 1 AS position
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)""")
def r01p(spark, d):
    o = tbl(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, None)
                                       .otherwise(F.col("o_totalprice")).alias("price"))
    return R.sort_positions(o, "price", "o_orderkey", desc=True)


@register("r02_text_positions", """
SELECT o_orderkey, o_totalprice,
       row_number() OVER (ORDER BY CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), o_orderkey) - 1 AS position
FROM orders""")
def r02p(spark, d):
    o = money(tbl(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return as_double(R.sort_positions(o, "o_totalprice", "o_orderkey", as_text=True), "o_totalprice")


@register("r03_page", """
SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""")
def r03(spark, d):
    return R.page(tbl(spark, d, "orders"), "o_totalprice", 3, 50, desc=True, key="o_orderkey")


@register("r03_page_info", """
SELECT COUNT(*) AS total_rows, CAST(greatest(1, ceil(COUNT(*) / 50.0)) AS BIGINT) AS total_pages FROM orders""")
def r03i(spark, d):
    return R.page_info(tbl(spark, d, "orders"), 50)


@register("r04_keep_metrics", """SELECT o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def r04(spark, d):
    return R.keep_metrics(tbl(spark, d, "orders"), ["o_totalprice"])


@register("r05_drop_missing", """
SELECT l_orderkey, NULLIF(l_linenumber, 3) AS ln, l_quantity FROM lineitem WHERE NULLIF(l_linenumber, 3) IS NOT NULL""")
def r05(spark, d):
    li = tbl(spark, d, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("ln"), "l_quantity")
    return R.drop_missing(li, "any")


@register("r06_drop_sparse", """SELECT o_orderkey, o_orderstatus FROM orders""")
def r06(spark, d):
    o = tbl(spark, d, "orders").select("o_orderkey", "o_orderstatus",
                                       F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("sparse"))
    return R.drop_sparse_columns(o, 0.5)


@register("r07_fill_display", """
SELECT l_orderkey, COALESCE(NULLIF(l_linenumber, 3), 0) AS ln,
       COALESCE(CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END, 'N/A') AS flag FROM lineitem""")
def r07(spark, d):
    li = tbl(spark, d, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("ln"),
                                          F.when(F.col("l_linenumber") == 2, None)
                                          .otherwise(F.col("l_returnflag")).alias("flag"))
    return R.fill_display(li)


@register("r08_finite", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders""")
def r08(spark, d):
    o = tbl(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan")))
                                       .otherwise(F.col("o_totalprice")).alias("v"))
    return R.finite(o)


@register("r09_nunique", """
SELECT 'l_orderkey' AS "column", COUNT(DISTINCT l_orderkey) AS nunique FROM lineitem
UNION ALL SELECT 'l_partkey', COUNT(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'l_suppkey', COUNT(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_linenumber', COUNT(DISTINCT l_linenumber) FROM lineitem
UNION ALL SELECT 'l_quantity', COUNT(DISTINCT l_quantity) FROM lineitem
UNION ALL SELECT 'l_extendedprice', COUNT(DISTINCT l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_discount', COUNT(DISTINCT l_discount) FROM lineitem
UNION ALL SELECT 'l_tax', COUNT(DISTINCT l_tax) FROM lineitem
UNION ALL SELECT 'l_returnflag', COUNT(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_linestatus', COUNT(DISTINCT l_linestatus) FROM lineitem
UNION ALL SELECT 'l_shipdate', COUNT(DISTINCT l_shipdate) FROM lineitem""")
def r09(spark, d):
    return R.nunique(tbl(spark, d, "lineitem"))


@register("r10_non_binary", """
SELECT "column", nunique FROM (
  SELECT 'o_orderkey' AS "column", COUNT(DISTINCT o_orderkey) AS nunique FROM orders
  UNION ALL SELECT 'o_custkey', COUNT(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', COUNT(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'o_totalprice', COUNT(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderdate', COUNT(DISTINCT o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', COUNT(DISTINCT o_orderpriority) FROM orders) WHERE nunique > 2""")
def r10(spark, d):
    prof = P.profile(tbl(spark, d, "orders"))
    return R.non_binary(prof).select("column", "nunique")


@register("r11_top_k", """
SELECT * FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def r11(spark, d):
    return R.top_k(tbl(spark, d, "orders"), "o_totalprice", 10, "o_orderkey")


@register("r12_retain", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT * FROM events e WHERE ts >= (SELECT MAX(ts) FROM events x WHERE x.event_type = e.event_type) - INTERVAL 24 HOUR))
WHERE rn <= 15""")
def r12(spark, d):
    return R.retain(tbl(spark, d, "events"), "ts", 24, 15, by=["event_type"], key="event_id")


# ==========================================================================
# P: profiling
# ==========================================================================

def num_stats_sql(t: str, c: str, pos: int, where: str = "TRUE") -> str:
    """One column's moments, quartiles and outlier count (DuckDB)."""
    return f"""SELECT '{c}' AS "column", {pos} AS position,
  (SELECT COUNT(*) FROM {t}) AS n_rows, COUNT({c}) AS non_null,
  AVG({c}) AS mean, MIN({c}) AS vmin, MAX({c}) AS vmax,
  (SELECT avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5)
     FROM {t}, (SELECT AVG({c}) m FROM {t} WHERE {where}) WHERE {c} IS NOT NULL AND {where}) AS skewness,
  (SELECT avg(power({c} - m, 4)) / power(avg(power({c} - m, 2)), 2) - 3
     FROM {t}, (SELECT AVG({c}) m FROM {t} WHERE {where}) WHERE {c} IS NOT NULL AND {where}) AS kurtosis,
  quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3,
  (SELECT COUNT(*) FROM {t}, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM {t} WHERE {where})
     WHERE {where} AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) AS outlier_count,
  COUNT(DISTINCT {c}) AS nunique
FROM {t} WHERE {where}"""


def _hist_ok_sql() -> str:
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    parts = " UNION ALL ".join(num_stats_sql("lineitem", c, i) for i, c in enumerate(cols))
    skip = "|".join(["count", "quantity", "qty", "_id", "index", "rank", "order", "year", "month", "day",
                     "hour", "minute", "second", "delta", "diff", "duration", "elapsed", "lag", "offset",
                     "tenure", "zipcode", "zip", "postal", "phone", "latitude", "longitude", "lat", "lon"])
    return f"""WITH s AS ({parts})
SELECT "column", NOT (regexp_matches(replace(lower("column"), '_', ' '), '({skip})')
                     OR (abs(COALESCE(skewness, 0)) < 0.3 AND COALESCE(outlier_count / n_rows, 0) < 0.03)) AS histogram
FROM s"""


@register("a13_histogram_ok", _hist_ok_sql())
def a13(spark, d):
    prof = P.profile(tbl(spark, d, "lineitem"))
    return A.histogram_ok(prof).where(~F.col("is_identifier")).select("column", "histogram")


_LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
             ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
             ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
             ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


def _profile_sql(t: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, ty) in enumerate(cols):
        if ty in ("bigint", "int", "double"):
            parts.append(num_stats_sql(t, c, i))
        else:
            parts.append(f"""SELECT '{c}' AS "column", {i} AS position, (SELECT COUNT(*) FROM {t}) AS n_rows,
  COUNT({c}) AS non_null, NULL::DOUBLE AS mean, NULL::DOUBLE AS vmin, NULL::DOUBLE AS vmax,
  NULL::DOUBLE AS skewness, NULL::DOUBLE AS kurtosis, NULL::DOUBLE AS q1, NULL::DOUBLE AS median,
  NULL::DOUBLE AS q3, NULL::BIGINT AS outlier_count, COUNT(DISTINCT {c}) AS nunique FROM {t}""")
    types = {c: ty for c, ty in cols}
    kinds = " UNION ALL ".join(
        f"SELECT '{c}' AS c, {str(ty in ('bigint', 'int', 'double')).upper()} AS is_num, "
        f"{str(ty in ('bigint', 'int')).upper()} AS is_int, {str(ty.startswith('timestamp')).upper()} AS is_time, "
        f"(SELECT COUNT(*) FROM {t} WHERE CAST({c} AS VARCHAR) IN ('True','False','Yes','No')"
        f"{' OR ' + c + ' IN (0, 1)' if ty in ('bigint', 'int', 'double') else ''}) AS bool_values"
        for c, ty in types.items())
    id_rx = "'^(id|uuid|pk|fk|key|code|ref|hash)|(id|uuid|pk|fk|key|code|ref|hash)$'"
    return f"""WITH s AS ({' UNION ALL '.join(parts)}), k AS ({kinds}),
j AS (SELECT s.*, k.* FROM s JOIN k ON s."column" = k.c),
r AS (SELECT *, replace(replace(lower("column"), '_', ''), ' ', '') AS cn,
             CASE WHEN n_rows > 0 THEN nunique / n_rows ELSE 0 END AS ur FROM j)
SELECT "column", position, n_rows, non_null, nunique,
  ROUND(CASE WHEN n_rows > 0 THEN 1 - non_null / n_rows ELSE 0 END, 4) AS missing_ratio,
  CASE WHEN is_time THEN 'datetime' WHEN nunique <= 2 AND bool_values = non_null THEN 'boolean'
       WHEN is_num AND is_int AND nunique <= 15 THEN 'discrete_numeric' WHEN is_num THEN 'continuous_numeric'
       ELSE 'categorical' END AS type,
  ROUND(mean, 5) AS mean, vmin AS "min", vmax AS "max", ROUND(skewness, 6) AS skewness,
  ROUND(kurtosis, 6) AS kurtosis, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  outlier_count, ROUND(outlier_count / n_rows, 6) AS outlier_ratio,
  CASE WHEN regexp_matches(cn, {id_rx}) THEN TRUE
       WHEN regexp_matches(cn, '(player|oyuncu)') THEN FALSE
       WHEN NOT is_num AND ur > 0.95 AND n_rows > 50 THEN TRUE
       WHEN regexp_matches(cn, '(name|title|label|description|isim|ad)') AND ur > 0.8 THEN TRUE
       ELSE FALSE END AS is_identifier
FROM r"""


_PROFILE_COLS = ["column", "position", "n_rows", "non_null", "nunique", "missing_ratio", "type", "mean", "min",
                 "max", "skewness", "kurtosis", "q1", "median", "q3", "outlier_count", "outlier_ratio",
                 "is_identifier"]


def _profile_out(prof: DataFrame) -> DataFrame:
    return rnd(prof.select(*_PROFILE_COLS), 6).withColumn("mean", F.round("mean", 5))


@register("p01_profile", _profile_sql("lineitem", _LINEITEM))
def p01(spark, d):
    return _profile_out(P.profile(tbl(spark, d, "lineitem")))


_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
             ("c_mktsegment", "string")]


@register("p09_profile_customer", _profile_sql("customer", _CUSTOMER))
def p09(spark, d):
    return _profile_out(P.profile(tbl(spark, d, "customer")))


def _part_to_whole_sql(t: str, cols: list[tuple[str, str]]) -> str:
    """Identifier and cardinality of every column from SQL; which columns are
    text or numbers from the catalogue."""
    from tablight.functions import keywords as KW
    mean = " OR ".join(f"contains(lower(m.\"column\"), '{w}')" for w in KW.MEAN_AGGREGATED)
    return f"""WITH p AS ({_profile_sql(t, cols)}),
k AS (SELECT p.*, i.data_type = 'VARCHAR' AS is_text,
             i.data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') OR i.data_type LIKE 'DECIMAL%' AS is_num
      FROM p JOIN information_schema.columns i ON i.table_name = '{t}' AND i.column_name = p."column"),
x AS (SELECT d."column" AS dimension, m."column" AS metric, d.nunique AS categories,
             CASE WHEN {mean} THEN 'mean' ELSE 'sum' END AS aggregation, d.is_identifier AS did, m.is_identifier AS mid
      FROM k d, k m WHERE d.is_text AND m.is_num),
r AS (SELECT *, concat_ws(',', CASE WHEN did THEN 'identifier_dimension' END,
               CASE WHEN categories < 2 THEN 'too_few_categories' END,
               CASE WHEN categories > 8 THEN 'too_many_categories' END,
               CASE WHEN mid THEN 'identifier_metric' END,
               CASE WHEN aggregation <> 'sum' THEN 'average_not_part_to_whole' END) AS why FROM x)
SELECT dimension, metric, aggregation, categories, NULLIF(why, '') AS reason, why = '' AS eligible FROM r"""


@register("a09_part_to_whole", _part_to_whole_sql("customer", _CUSTOMER))
def a09(spark, d):
    return A.part_to_whole_pairs(tbl(spark, d, "customer"))


@register("p06_dominant_flag", """
WITH f AS (SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 10 = 3 THEN o_orderpriority ELSE 'usual' END AS note,
                  o_orderkey AS number FROM orders),
c AS (SELECT 'status' AS "column", status AS v, COUNT(*) AS n FROM f WHERE status IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'note', note, COUNT(*) FROM f WHERE note IS NOT NULL GROUP BY 2)
SELECT "column", MAX(n) AS top_count, ROUND(MAX(n) / SUM(n), 6) AS top_share, MAX(n) / SUM(n) > 0.8 AS dominant_flag
FROM c GROUP BY 1 UNION ALL SELECT 'number', 1, ROUND(1.0 / COUNT(*), 6), FALSE FROM f""")
def p06(spark, d):
    o = tbl(spark, d, "orders").select(
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderpriority")).otherwise("usual").alias("note"),
        F.col("o_orderkey").alias("number"))
    return rnd(P.profile(o).select("column", "top_count", "top_share", "dominant_flag"), 6)


@register("p07_missing_unique", """
SELECT 'o_orderkey' AS "column", ROUND(AVG(CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0.0 END), 4) AS missing_ratio,
       COUNT(DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END) AS unique_count FROM orders
UNION ALL SELECT 'o_orderstatus', 0.0, COUNT(DISTINCT o_orderstatus) FROM orders""")
def p07(spark, d):
    o = tbl(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderkey"))
                                       .alias("o_orderkey"), "o_orderstatus")
    return P.column_cards(o).select("column", "missing_ratio", "unique_count")


@register("p08_cards_top_values", """
SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, COUNT(*) AS "count" FROM orders
GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3""")
def p08(spark, d):
    cards = P.column_cards(tbl(spark, d, "orders").select("o_orderkey", "o_orderpriority"))
    return cards.where(F.col("column") == "o_orderpriority").select("column", F.inline("top_values"))


def _cards_sql(table: str, numbers: list[str], others: list[str]) -> str:
    num = [f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS unique_count, CAST(MIN({c}) AS DOUBLE) AS num_min, "
           f"CAST(MAX({c}) AS DOUBLE) AS num_max, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS \"count\" "
           f"FROM {table}" for c in numbers]
    top = [f"SELECT * FROM (SELECT '{c}', (SELECT COUNT(DISTINCT {c}) FROM {table}), NULL, NULL, "
           f"CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
           f"ORDER BY n DESC, v LIMIT 3)" for c in others]
    return " UNION ALL ".join(num + top)


@register("p08_cards_all_columns", _cards_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"],
                                              ["o_orderstatus", "o_orderdate", "o_orderpriority"]))
def p08a(spark, d):
    return P.column_cards(tbl(spark, d, "orders")).select("column", "unique_count", "num_min", "num_max",
                                                          F.inline_outer("top_values"))


@register("p11_label_column", """
WITH c AS (SELECT 'c_name' AS "column", 0 AS position, COUNT(DISTINCT c_name) AS unique_count FROM customer
           UNION ALL SELECT 'c_mktsegment', 4, COUNT(DISTINCT c_mktsegment) FROM customer),
s AS (SELECT *, CASE WHEN "column" LIKE '%name%' THEN 88 WHEN "column" LIKE '%segment%' THEN 0 ELSE 0 END AS score FROM c)
SELECT "column", score, unique_count FROM s ORDER BY score DESC, unique_count DESC, position LIMIT 1""")
def p11(spark, d):
    return P.label_column(tbl(spark, d, "customer"))


_P12 = _LI4 + ["l_linenumber"]


def _central_sql(top_n: int = 2) -> str:
    var = " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS position, var_samp({c}) AS v FROM lineitem"
                             for i, c in enumerate(_P12))
    sp = _spearman_sql("lineitem", _P12).replace("WITH rk AS", "rk AS", 1)
    return f"""WITH vs AS ({var}),
cut AS (SELECT quantile_cont(v, 0.25) q FROM vs),
act0 AS (SELECT c, position FROM vs, cut WHERE v > q),
act AS (SELECT * FROM act0 WHERE (SELECT COUNT(*) FROM act0) >= {top_n}
        UNION ALL SELECT c, position FROM vs WHERE (SELECT COUNT(*) FROM act0) < {top_n}),
{sp.split(" SELECT ", 1)[0]},
m AS (SELECT {sp.split(" SELECT ", 1)[1]}),
ma AS (SELECT * FROM m WHERE col_a IN (SELECT c FROM act) AND col_b IN (SELECT c FROM act)),
both_ AS (SELECT col_a AS c, r FROM ma UNION ALL SELECT col_b, r FROM ma),
k AS (SELECT COUNT(*) k FROM act)
SELECT both_.c AS "column", ROUND(SUM(abs(COALESCE(r, 0))) / MAX(k.k), 6) AS centrality
FROM both_ JOIN act ON both_.c = act.c, k
GROUP BY both_.c, act.position ORDER BY centrality DESC, act.position LIMIT {top_n}"""


@register("p12_central_columns", _central_sql())
def p12(spark, d):
    return rnd(P.central_columns(tbl(spark, d, "lineitem"), _P12, 2), 6)


@register("p13_clean_text", f"""
SELECT doc_id, {clean_text_sql("text")} AS text_clean FROM documents""")
def p13(spark, d):
    return tbl(spark, d, "documents").select("doc_id", clean_text("text").alias("text_clean"))


# ==========================================================================
# K: KPIs
# ==========================================================================

@register("k04_kpi_values", """
SELECT 'l_quantity' AS "column", 'sum' AS aggregation, ROUND(SUM(l_quantity), 2) AS value, 'Total L Quantity' AS title FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'sum', ROUND(SUM(l_extendedprice), 2), 'Total L Extendedprice' FROM lineitem
UNION ALL SELECT 'l_discount', 'sum', ROUND(SUM(l_discount), 2), 'Total L Discount' FROM lineitem
UNION ALL SELECT 'l_tax', 'sum', ROUND(SUM(l_tax), 2), 'Total L Tax' FROM lineitem""")
def k04(spark, d):
    return rnd(KP.kpi_values(tbl(spark, d, "lineitem"), _LI4), 2)


@register("k05_kpi_trend", """
WITH x AS (SELECT o_totalprice v, row_number() OVER (ORDER BY o_orderdate IS NULL, o_orderdate, o_orderkey) - 1 AS rn,
                  COUNT(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL),
t AS (SELECT MAX(n) n, AVG(CASE WHEN rn < n // 2 THEN v END) a, AVG(CASE WHEN rn >= n // 2 THEN v END) b FROM x)
SELECT 'o_totalprice' AS "column", n, ROUND(a, 4) AS first_half_mean, ROUND(b, 4) AS second_half_mean,
       ROUND(CASE WHEN n >= 4 AND a <> 0 THEN (b - a) / abs(a) * 100 END, 6) AS pct_change,
       CASE WHEN (b - a) / abs(a) * 100 > 1 THEN 'up' WHEN (b - a) / abs(a) * 100 < -1 THEN 'down' ELSE 'neutral' END AS direction
FROM t""")
def k05(spark, d):
    t = KP.kpi_trend(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], "o_orderkey")
    return rnd(rnd(t, 6).withColumn("first_half_mean", F.round("first_half_mean", 4))
               .withColumn("second_half_mean", F.round("second_half_mean", 4)), 6)


@register("k06_plan_kpis", """
SELECT 1 AS slot, 'o_totalprice' AS "column", 'mean' AS aggregation, ROUND(AVG(o_totalprice), 4) AS value FROM orders
UNION ALL SELECT 2, 'o_custkey', 'sum', ROUND(CAST(SUM(o_custkey) AS DOUBLE), 4) FROM orders""")
def k06(spark, d):
    spark_defs = spark.createDataFrame(
        [("o_custkey", "sum", "secondary_metric", "accepted", 0),
         ("o_totalprice", "mean", "primary_metric", "repaired", 1),
         ("o_orderstatus", "count", "dimension", "accepted", 2),
         ("o_totalprice", "sum", "secondary_metric", "accepted", 3)],
        "column string, aggregation string, role string, validation_status string, ord int")
    return rnd(KP.plan_kpis(tbl(spark, d, "orders"), spark_defs), 4)


@register("k07_record_count", """SELECT 'kpi-count' AS id, 'Total Records' AS title, COUNT(*) AS value FROM documents""")
def k07(spark, d):
    return KP.record_count(tbl(spark, d, "documents"))


@register("k08_kpi_columns", """
SELECT label, 0 AS priority, nunique, nunique <= 2 AS is_binary FROM (
  SELECT 'l_linenumber' AS label, COUNT(DISTINCT l_linenumber) AS nunique FROM lineitem
  UNION ALL SELECT 'l_quantity', COUNT(DISTINCT l_quantity) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', COUNT(DISTINCT l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', COUNT(DISTINCT l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', COUNT(DISTINCT l_tax) FROM lineitem)""")
def k08(spark, d):
    return KP.kpi_columns(P.profile(tbl(spark, d, "lineitem")))


# ==========================================================================
# T: statistical tests
# ==========================================================================

def _shape_sql(t: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(num_stats_sql(t, c, i))
    return f"""WITH s AS ({' UNION ALL '.join(parts)}),
x AS (SELECT "column", non_null, skewness, kurtosis,
             CASE WHEN q3 - q1 = 0 THEN 0.0 ELSE outlier_count / non_null END AS outlier_ratio FROM s)
SELECT "column", non_null, ROUND(skewness, 6) AS skewness, ROUND(kurtosis, 6) AS kurtosis,
       ROUND(outlier_ratio, 6) AS outlier_ratio, NULL::DOUBLE AS p_value, FALSE AS is_normal,
       CASE WHEN non_null < 8 THEN 'insufficient_data' WHEN outlier_ratio >= 0.08 THEN 'outlier_sensitive'
            WHEN abs(kurtosis) >= 2 THEN 'heavy_tailed' WHEN abs(skewness) >= 0.75 THEN 'skewed'
            ELSE 'non_normal' END AS shape
FROM x"""


@register("t01_shapiro", None)
def t01(spark, d):
    return rnd(S.shapiro(tbl(spark, d, "lineitem"), _LI4), 6)


@register("t02_shape", _shape_sql("lineitem", _LI4))
def t02(spark, d):
    return rnd(S.shape(tbl(spark, d, "lineitem"), _LI4), 6)


@register("t03_missing_meta", """
SELECT COUNT(*) AS total_rows, COUNT(CASE WHEN NULLIF(l_linenumber, 3) IS NOT NULL AND l_quantity IS NOT NULL THEN 1 END) AS sample_size,
       COUNT(*) - COUNT(CASE WHEN NULLIF(l_linenumber, 3) IS NOT NULL AND l_quantity IS NOT NULL THEN 1 END) AS missing_dropped_count,
       ROUND((COUNT(*) - COUNT(CASE WHEN NULLIF(l_linenumber, 3) IS NOT NULL AND l_quantity IS NOT NULL THEN 1 END)) / COUNT(*), 6) AS missing_ratio
FROM lineitem""")
def t03(spark, d):
    li = tbl(spark, d, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("ln"), "l_quantity")
    return rnd(S.missing_meta(li, ["ln", "l_quantity"]), 6)


@register("t04_midranks", """
SELECT o_orderstatus, value, cnt,
       COALESCE(SUM(cnt) OVER (PARTITION BY o_orderstatus ORDER BY value
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cnt + 1) / 2.0 AS "rank"
FROM (SELECT o_orderstatus, o_totalprice AS value, COUNT(*) AS cnt FROM orders
      WHERE o_totalprice IS NOT NULL GROUP BY 1, 2)""")
def t04(spark, d):
    from tablight.functions.ordering import midranks
    return midranks(tbl(spark, d, "orders"), ["o_orderstatus"], "o_totalprice") \
        .select("o_orderstatus", F.col("o_totalprice").alias("value"), "cnt", "rank")


@register("t05_spearman", f"""
WITH m AS ({_spearman_sql("lineitem", _LI4)})
SELECT col_a, col_b, ROUND(r, 6) AS r, n FROM m""")
def t05(spark, d):
    return rnd(S.spearman_matrix(tbl(spark, d, "lineitem"), _LI4).select("col_a", "col_b", "r", "n"), 6)


def _group_rank_sql(t: str, cat: str, num: str) -> str:
    return f"""WITH g AS (SELECT {cat} AS lvl, {num} AS v FROM {t} WHERE {cat} IS NOT NULL AND {num} IS NOT NULL),
sz AS (SELECT lvl, COUNT(*) n_g FROM g GROUP BY 1),
e AS (SELECT g.* FROM g JOIN sz USING (lvl) WHERE n_g >= 5),
r AS (SELECT lvl, v, rank() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM e),
rs AS (SELECT lvl, SUM(rk) R, COUNT(*) n_g FROM r GROUP BY 1),
ties AS (SELECT SUM(t * t * t - t) tie, SUM(t) n FROM (SELECT COUNT(*) t FROM e GROUP BY v))"""


@register("t06_mann_whitney", _group_rank_sql("lineitem", "l_linestatus", "l_extendedprice") + """
SELECT ROUND(MIN_BY(R, lvl) - MIN_BY(n_g, lvl) * (MIN_BY(n_g, lvl) + 1) / 2.0, 4) AS statistic,
       MIN_BY(n_g, lvl) AS n1, MAX_BY(n_g, lvl) AS n2,
       ROUND(abs(1 - 2 * (MIN_BY(R, lvl) - MIN_BY(n_g, lvl) * (MIN_BY(n_g, lvl) + 1) / 2.0)
                 / (MIN_BY(n_g, lvl) * MAX_BY(n_g, lvl))), 6) AS effect_size
FROM rs""")
def t06(spark, d):
    t = S.group_tests(tbl(spark, d, "lineitem"), ["l_linestatus"], ["l_extendedprice"], posthoc=False)
    return rnd(t.select(F.round("statistic", 4).alias("statistic"), "n1", "n2", "effect_size"), 6)


@register("t07_kruskal", _group_rank_sql("orders", "o_orderstatus", "o_totalprice") + """,
h AS (SELECT (12.0 / (n * (n + 1)) * (SELECT SUM(R * R / n_g) FROM rs) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS H,
             (SELECT COUNT(*) FROM rs) AS k, (SELECT COUNT(*) FROM g) AS sample_size FROM ties)
SELECT ROUND(H, 6) AS statistic, ROUND(exp(-H / 2), 6) AS p_value, k AS group_count, sample_size,
       ROUND(CASE WHEN sample_size > k THEN greatest(0, (H - k + 1) / (sample_size - k)) ELSE 0 END, 6) AS effect_size
FROM h""")
def t07(spark, d):
    t = S.group_tests(tbl(spark, d, "orders"), ["o_orderstatus"], ["o_totalprice"], posthoc=False)
    return rnd(t.select("statistic", "p_value", "group_count", "sample_size", "effect_size"), 6)


@register("t08_posthoc", """
WITH g AS (SELECT o_orderpriority AS lvl, o_totalprice AS v FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
lv AS (SELECT lvl, COUNT(*) n_g, quantile_cont(v, 0.5) med FROM g GROUP BY 1 HAVING COUNT(*) >= 5),
pr AS (SELECT a.lvl AS group_a, b.lvl AS group_b, a.n_g AS n_a, b.n_g AS n_b, a.med - b.med AS median_diff
       FROM lv a JOIN lv b ON a.lvl < b.lvl),
x AS (SELECT group_a, group_b, g.lvl, g.v FROM pr JOIN g ON g.lvl = pr.group_a OR g.lvl = pr.group_b),
r AS (SELECT group_a, group_b, lvl, rank() OVER (PARTITION BY group_a, group_b ORDER BY v)
             + (COUNT(*) OVER (PARTITION BY group_a, group_b, v) - 1) / 2.0 AS rk FROM x),
ra AS (SELECT group_a, group_b, SUM(rk) R_a FROM r WHERE lvl = group_a GROUP BY 1, 2)
SELECT pr.group_a, pr.group_b, ROUND(R_a - n_a * (n_a + 1) / 2.0, 4) AS u,
       ROUND(abs(1 - 2 * (R_a - n_a * (n_a + 1) / 2.0) / (n_a * n_b)), 6) AS effect_size,
       ROUND(median_diff, 4) AS median_diff
FROM pr JOIN ra USING (group_a, group_b)""")
def t08(spark, d):
    t = S.posthoc_all(tbl(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return t.select("group_a", "group_b", F.round("u", 4).alias("u"), F.round("effect_size", 6).alias("effect_size"),
                    F.round("median_diff", 4).alias("median_diff"))


def _chi_sql(t: str, a: str, b: str) -> str:
    return f"""WITH c AS (SELECT CAST({a} AS VARCHAR) la, CAST({b} AS VARCHAR) lb, COUNT(*) o FROM {t}
           WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
rt AS (SELECT la, SUM(o) rt FROM c GROUP BY 1), ct AS (SELECT lb, SUM(o) ct FROM c GROUP BY 1),
n AS (SELECT SUM(o) n FROM c),
g AS (SELECT rt.la, ct.lb, COALESCE(c.o, 0) AS o, rt * ct / n AS e FROM rt CROSS JOIN ct CROSS JOIN n
      LEFT JOIN c ON c.la = rt.la AND c.lb = ct.lb),
d AS (SELECT (SELECT COUNT(*) FROM rt) r, (SELECT COUNT(*) FROM ct) k, (SELECT n FROM n) n),
s AS (SELECT SUM(power(CASE WHEN (r - 1) * (k - 1) = 1 THEN greatest(abs(o - e) - 0.5, 0) ELSE abs(o - e) END, 2) / e) chi2,
             MIN(e) emin, AVG(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) sparse FROM g, d)"""


@register("t10_chi_square", _chi_sql("lineitem", "l_returnflag", "l_linestatus") + """
SELECT r, k AS c, (r - 1) * (k - 1) AS dof, n AS sample_size, ROUND(chi2, 6) AS chi2,
       ROUND(sqrt(chi2 / (n * (least(r, k) - 1))), 6) AS cramers_v, ROUND(exp(-chi2 / 2), 6) AS chi2_p,
       ROUND(emin, 6) AS expected_min, ROUND(sparse, 6) AS sparse_cell_ratio, sparse > 0.2 AS sparse_warning
FROM s, d""")
def t10(spark, d):
    t = S.chi_square(tbl(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return rnd(t.select("r", "c", "dof", "sample_size", "chi2", "cramers_v", "chi2_p", "expected_min",
                        "sparse_cell_ratio", "sparse_warning"), 6)


@register("t13_fisher_2x2", _chi_sql("labels", "quality", "toxic") + """
SELECT ROUND(chi2, 6) AS chi2, ROUND(sqrt(chi2 / (n * (least(r, k) - 1))), 6) AS cramers_v,
       ROUND(emin, 6) AS expected_min,
       CASE WHEN r = 2 AND k = 2 AND sparse > 0 THEN 'fisher_exact' ELSE 'chi_square' END AS method
FROM s, d""")
def t13(spark, d):
    t = S.chi_square(tbl(spark, d, "labels"), "quality", "toxic")
    return rnd(t.select("chi2", "cramers_v", "expected_min", "method"), 6)


@register("t14_dependencies", _chi_sql("lineitem", "l_returnflag", "l_linestatus") + """,
x AS (SELECT chi2, sqrt(chi2 / (n * (least(r, k) - 1))) AS v, exp(-chi2 / 2) AS p, n, sparse FROM s, d)
SELECT 'l_returnflag' AS col_a, 'l_linestatus' AS col_b, ROUND(chi2, 6) AS chi2, ROUND(v, 6) AS cramers_v,
       ROUND(p, 6) AS p_value, ROUND(LEAST(1.0, p), 6) AS q_value,
       CASE WHEN v >= 0.5 THEN 'large' WHEN v >= 0.3 THEN 'medium' WHEN v >= 0.1 THEN 'small' ELSE 'negligible' END
         AS effect_label
FROM x""")
def t14(spark, d):
    t = S.dependencies(tbl(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], min_v=0.0)
    return rnd(t.select("col_a", "col_b", "chi2", "cramers_v", "p_value", "q_value", "effect_label"), 6)


def _kw_sql_for(metric: str) -> str:
    return _group_rank_sql("lineitem", "l_returnflag", metric) + f""",
h AS (SELECT (12.0 / (n * (n + 1)) * (SELECT SUM(R * R / n_g) FROM rs) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS H FROM ties)
SELECT '{metric}' AS numeric_col, exp(-H / 2) AS p FROM h"""


@register("t15_bh", "WITH p AS (" + " UNION ALL ".join(f"SELECT * FROM ({_kw_sql_for(m)})" for m in _LI4) + """),
o AS (SELECT numeric_col, p, row_number() OVER (ORDER BY p) rk, COUNT(*) OVER () m FROM p)
SELECT numeric_col, ROUND(p, 6) AS p_value,
       ROUND(LEAST(1.0, MIN(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value
FROM o""")
def t15(spark, d):
    t = S.group_tests(tbl(spark, d, "lineitem"), ["l_returnflag"], _LI4, posthoc=False)
    return rnd(t.select("numeric_col", "p_value", "q_value"), 6)


def _kw_one_sql(t: str, cat: str, num: str, dof: int) -> str:
    tail = " + ".join(f"power(H / 2, {i}) / {math.factorial(i)}" for i in range(dof // 2))
    return _group_rank_sql(t, cat, num) + f""",
h AS (SELECT (12.0 / (n * (n + 1)) * (SELECT SUM(R * R / n_g) FROM rs) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS H,
             (SELECT COUNT(*) FROM rs) AS k, (SELECT COUNT(*) FROM g) AS sample_size FROM ties)
SELECT '{cat}' AS categorical_col, '{num}' AS numeric_col, 'Kruskal-Wallis' AS test, k AS group_count,
       sample_size, H AS statistic, exp(-H / 2) * ({tail}) AS p_value,
       CASE WHEN sample_size > k THEN greatest(0, (H - k + 1) / (sample_size - k)) ELSE 0 END AS effect_size
FROM h"""


def _sweep_sql() -> str:
    parts = [_kw_one_sql("orders", "o_orderstatus", "o_totalprice", 2),
             _kw_one_sql("orders", "o_orderpriority", "o_totalprice", 4)]
    return "WITH t AS (" + " UNION ALL ".join(f"SELECT * FROM ({x})" for x in parts) + """),
o AS (SELECT *, row_number() OVER (ORDER BY p_value) rk, COUNT(*) OVER () m FROM t),
q AS (SELECT *, LEAST(1.0, MIN(p_value * m / rk) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
             AS q_value FROM o)
SELECT categorical_col, numeric_col, test, group_count, sample_size, ROUND(statistic, 6) AS statistic,
       ROUND(p_value, 6) AS p_value, ROUND(q_value, 6) AS q_value, ROUND(effect_size, 6) AS effect_size,
       q_value < 0.05 AS significant,
       CASE WHEN abs(effect_size) >= 0.5 THEN 'large' WHEN abs(effect_size) >= 0.3 THEN 'medium'
            WHEN abs(effect_size) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect_label,
       CASE WHEN sample_size >= 30 AND q_value < 0.01 AND effect_size >= 0.5 THEN 'high'
            WHEN sample_size >= 20 AND q_value < 0.05 AND effect_size >= 0.3 THEN 'medium'
            WHEN q_value < 0.1 AND effect_size >= 0.1 THEN 'low' ELSE 'exploratory' END AS quality
FROM q"""


@register("t09_group_sweep", _sweep_sql())
def t09(spark, d):
    t = S.group_sweep(tbl(spark, d, "orders"))
    return rnd(t.select("categorical_col", "numeric_col", "test", "group_count", "sample_size", "statistic",
                        "p_value", "q_value", "effect_size", "significant", "effect_label", "quality"), 6)


_BANDS = ("(SELECT CAST(floor((l_quantity - 1) / 17) AS BIGINT)::VARCHAR AS band, l_quantity, "
          "l_quantity * (1 - l_discount) AS net, l_discount FROM lineitem) z")


def _grouped_sql() -> str:
    parts = [_kw_one_sql(_BANDS, "band", m, 2) for m in ("l_quantity", "net", "l_discount")]
    return "WITH t AS (" + " UNION ALL ".join(f"SELECT * FROM ({x})" for x in parts) + """),
o AS (SELECT *, row_number() OVER (ORDER BY p_value) rk, COUNT(*) OVER () m FROM t),
q AS (SELECT *, LEAST(1.0, MIN(p_value * m / rk) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
             AS q_value FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY categorical_col ORDER BY q_value, numeric_col) AS place FROM q),
g AS (SELECT categorical_col, string_agg(numeric_col, ',' ORDER BY numeric_col) FILTER (q_value < 0.05) AS affected_cols,
             MAX(abs(effect_size)) AS e, MIN(q_value) AS qv, MAX(sample_size) AS sample_size
      FROM b WHERE place <= 2 GROUP BY 1 HAVING COUNT(*) FILTER (q_value < 0.05) >= 2)
SELECT categorical_col, affected_cols, ROUND(e, 6) AS effect_size, ROUND(qv, 6) AS q_value, sample_size,
       CASE WHEN e >= 0.5 THEN 'large' WHEN e >= 0.3 THEN 'medium' WHEN e >= 0.1 THEN 'small' ELSE 'negligible' END
         AS effect_label,
       CASE WHEN sample_size >= 30 AND qv < 0.01 AND e >= 0.5 THEN 'high'
            WHEN sample_size >= 20 AND qv < 0.05 AND e >= 0.3 THEN 'medium'
            WHEN qv < 0.1 AND e >= 0.1 THEN 'low' ELSE 'exploratory' END AS quality, CAST(1.5 AS DOUBLE) AS score
FROM g"""


@register("t17_grouped_findings", _grouped_sql())
def t17(spark, d):
    li = tbl(spark, d, "lineitem").select(
        F.floor((F.col("l_quantity") - 1) / 17).cast("string").alias("band"), "l_quantity",
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"), "l_discount")
    tests = S.group_tests(li, ["band"], ["l_quantity", "net", "l_discount"], posthoc=False)
    t = S.grouped_findings(S.best_per_category(tests))
    return rnd(t.select("categorical_col", F.concat_ws(",", "affected_cols").alias("affected_cols"), "effect_size",
                        "q_value", "sample_size", "effect_label", "quality", "score"), 6)


@register("t18_rank_insights", None)
def t18(spark, d):
    o = tbl(spark, d, "lineitem")
    corr = S.spearman_tests(o, _LI4)
    groups = S.group_tests(o, ["l_returnflag", "l_linestatus"], _LI4, posthoc=False)
    chi = S.dependencies(o, ["l_returnflag", "l_linestatus"], min_v=0.0)
    return rnd(S.rank_insights(corr, groups, chi), 6)


# ==========================================================================
# F: forecasting
# ==========================================================================

_MONTHLY_SQL = """WITH s AS (SELECT 'o_totalprice' AS metric, 'month' AS freq, last_day(o_orderdate) AS period, AVG(o_totalprice) y
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 3 HAVING AVG(o_totalprice) IS NOT NULL),
ser AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS idx FROM s)"""


@register("f02_frequency", """
SELECT 'orders' AS t, datediff('day', MIN(o_orderdate), MAX(o_orderdate)) AS span_days,
       CASE WHEN datediff('day', MIN(o_orderdate), MAX(o_orderdate)) > 730 THEN 'year'
            WHEN datediff('day', MIN(o_orderdate), MAX(o_orderdate)) > 60 THEN 'month' ELSE 'week' END AS freq FROM orders
UNION ALL SELECT 'events', datediff('day', MIN(ts), MAX(ts)),
       CASE WHEN datediff('day', MIN(ts), MAX(ts)) > 730 THEN 'year'
            WHEN datediff('day', MIN(ts), MAX(ts)) > 60 THEN 'month' ELSE 'week' END FROM events""")
def f02(spark, d):
    a = FS.frequency(tbl(spark, d, "orders"), "o_orderdate").select(F.lit("orders").alias("t"), "span_days", "freq")
    b = FS.frequency(tbl(spark, d, "events"), "ts").select(F.lit("events").alias("t"), "span_days", "freq")
    return a.unionByName(b)


@register("f03_series_month", _MONTHLY_SQL + """
SELECT metric, freq, period, ROUND(y, 4) AS y, idx FROM ser""")
def f03(spark, d):
    return rnd(FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month"), 4)


@register("f03_series_week_auto", """
WITH s AS (SELECT 'value' AS metric, 'week' AS freq, CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS period,
                  AVG(value) y FROM events WHERE ts IS NOT NULL GROUP BY 3)
SELECT metric, freq, period, ROUND(y, 4) AS y, row_number() OVER (ORDER BY period) - 1 AS idx FROM s""")
def f03w(spark, d):
    return rnd(FS.series(tbl(spark, d, "events"), "ts", ["value"]), 4)


@register("f04_trend_fit", _MONTHLY_SQL + """
SELECT metric, COUNT(*) AS n, ROUND(regr_slope(y, idx), 6) AS slope, ROUND(regr_intercept(y, idx), 6) AS intercept,
       ROUND(COALESCE(regr_r2(y, idx), 0), 6) AS r2, MAX(period) AS last_period, 'month' AS freq FROM ser GROUP BY 1""")
def f04(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    return rnd(FS.trend_fit(ser), 6)


@register("f06_extrapolate", _MONTHLY_SQL + """,
fit AS (SELECT metric, COUNT(*) n, regr_slope(y, idx) b, regr_intercept(y, idx) a, MAX(period) lp FROM ser GROUP BY 1)
SELECT metric, CAST(step AS INTEGER) AS step, last_day(lp + to_months(CAST(step AS INTEGER))) AS period,
       ROUND(a + b * (n - 1 + step), 4) AS forecast
FROM fit, range(1, 7) t(step)""")
def f06(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    return rnd(FS.extrapolate(ser, 6), 4)


@register("f07_backtest", _MONTHLY_SQL + """,
n AS (SELECT COUNT(*) n FROM ser), h AS (SELECT n, greatest(2, least(6, n // 5)) AS hold FROM n),
fit AS (SELECT regr_slope(y, idx) b, regr_intercept(y, idx) a FROM ser, h WHERE idx < n - hold),
e AS (SELECT y, y - (a + b * idx) AS err FROM ser, h, fit WHERE idx >= n - hold)
SELECT 'o_totalprice' AS metric, CAST((SELECT hold FROM h) AS INTEGER) AS holdout_points,
       ROUND(AVG(abs(err)), 3) AS mae, ROUND(sqrt(AVG(err * err)), 3) AS rmse,
       ROUND(AVG(CASE WHEN abs(y) >= 1e-9 THEN abs(err / y) END) * 100, 3) AS mape FROM e""")
def f07(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    return FS.backtest(ser)


@register("f05_holt_fixed", _MONTHLY_SQL.replace("WITH s AS", "WITH RECURSIVE s AS") + """,
h(idx, l, b, sse) AS (
  SELECT 0, (SELECT y FROM ser WHERE idx = 0), (SELECT y FROM ser WHERE idx = 1) - (SELECT y FROM ser WHERE idx = 0), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT s.idx, 0.5 * s.y + 0.5 * (h.l + h.b),
         0.3 * ((0.5 * s.y + 0.5 * (h.l + h.b)) - h.l) + 0.7 * h.b,
         h.sse + power(s.y - (h.l + h.b), 2)
  FROM h JOIN ser s ON s.idx = h.idx + 1)
SELECT 'o_totalprice' AS metric, CAST(0.5 AS DOUBLE) AS alpha, CAST(0.3 AS DOUBLE) AS beta, ROUND(sse, 2) AS sse, ROUND(l, 4) AS level,
       ROUND(b, 4) AS trend FROM h WHERE idx = (SELECT MAX(idx) FROM ser)""")
def f05f(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    out = FS.holt(ser, 6, params=[(0.5, 0.3)]).select("metric", "alpha", "beta", "sse", "level", "trend")
    return out.select("metric", "alpha", "beta", F.round("sse", 2).alias("sse"), F.round("level", 4).alias("level"),
                      F.round("trend", 4).alias("trend"))


@register("f05_holt", None)
def f05(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    return rnd(FS.holt(ser, 6).drop("forecast", "fitted"), 6)


@register("f08_direction", _MONTHLY_SQL + """,
fit AS (SELECT COUNT(*) n, regr_slope(y, idx) b, regr_intercept(y, idx) a FROM ser),
fc AS (SELECT step, a + b * (n - 1 + step) AS v FROM fit, range(1, 7) t(step)),
g AS (SELECT COUNT(*) n, arg_min(v, step) f, arg_max(v, step) l, AVG(v) m, covar_pop(v, step) cv, var_pop(step) vr FROM fc)
SELECT 'o_totalprice' AS metric, CASE WHEN n < 2 THEN 'stable'
  WHEN abs((l - f) / greatest(abs(f), abs(m), 1.0)) >= 0.02 THEN CASE WHEN l > f THEN 'upward' ELSE 'downward' END
  WHEN abs(cv / vr * (n - 1) / greatest(abs(f), abs(m), 1.0)) >= 0.01 THEN CASE WHEN cv > 0 THEN 'upward' ELSE 'downward' END
  ELSE 'stable' END AS direction FROM g""")
def f08(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    fc = FS.extrapolate(ser, 6)
    return FS.direction(fc, ["metric"], "step", "forecast").select("metric", "direction")


@register("f01_date_column", """
WITH f AS (SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day,
                  CASE WHEN o_orderkey % 10 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'order ' || o_orderkey END AS note
           FROM orders),
l AS (SELECT 0 AS position, 'priority' AS "column", priority AS v FROM f UNION ALL SELECT 1, 'note', note FROM f
      UNION ALL SELECT 2, 'day', day FROM f),
s AS (SELECT position, "column", COUNT(*) FILTER (trim(v) <> '') AS non_blank, COUNT(TRY_CAST(v AS DATE)) AS parsed,
             COUNT(DISTINCT TRY_CAST(v AS DATE)) AS days FROM l GROUP BY 1, 2)
SELECT position, "column", non_blank, parsed,
       parsed >= greatest(2, least(4, non_blank // 2), 4 * non_blank / 25.0) AND days >= 2 AS is_date FROM s""")
def f01(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = tbl(spark, d, "orders").select(
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 10 == 3, day).otherwise(F.concat(F.lit("order "), F.col("o_orderkey"))).alias("note"),
        day.alias("day"))
    return FS.date_evidence(o).select("position", "column", "non_blank", "parsed", "is_date")


# ==========================================================================
# J: joins
# ==========================================================================

@register("j01_auto_join", """
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def j01(spark, d):
    docs = tbl(spark, d, "documents").select("doc_id", "lang", "source")
    return J.auto_join([docs, tbl(spark, d, "labels")])


@register("j01_whole_documents", """
SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def j01w(spark, d):
    return J.auto_join([tbl(spark, d, "documents"), tbl(spark, d, "labels")])


@register("j02_fuzzy_join", """
SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""")
def j02(spark, d):
    return J.auto_join([tbl(spark, d, "orders"), tbl(spark, d, "customer")])


@register("j03_join_safety", """
WITH l AS (SELECT o_custkey k, COUNT(*) c FROM orders GROUP BY 1), r AS (SELECT c_custkey k, COUNT(*) c FROM customer GROUP BY 1)
SELECT CAST(SUM(l.c) AS BIGINT) AS left_rows, MAX(l.c > 1) AS left_dupes,
       CAST(SUM(l.c * COALESCE(r.c, 1)) AS BIGINT) AS joined_rows,
       ROUND(SUM(CASE WHEN r.c IS NOT NULL THEN l.c ELSE 0 END) / SUM(l.c), 6) AS match_rate,
       (SELECT MAX(c > 1) FROM r) AS right_dupes, MAX(l.c > 1) AND (SELECT MAX(c > 1) FROM r) AS many_to_many
FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def j03(spark, d):
    cust = tbl(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return rnd(J.join_safety(tbl(spark, d, "orders"), cust, ["o_custkey"]), 6)


# ==========================================================================
# S: sources and coercion
# ==========================================================================

@register("s03_parquet_roundtrip", """SELECT * FROM lineitem""")
def s03(spark, d):
    from tablight.session import checkpoint_dir
    from tablight.sources import files
    import uuid
    path = f"{checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}"
    files.save(tbl(spark, d, "lineitem"), path)
    return files.load(spark, path)


def _scratch(spark: SparkSession, kind: str) -> str:
    import uuid
    from tablight.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@register("s01_csv_read", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def s01(spark, d):
    from tablight.sources import files
    path = _scratch(spark, "csv")
    (tbl(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
     .write.option("header", True).option("sep", ";").csv(path))
    return files.read_csv(spark, path)


@register("s01_csv_all_columns", """SELECT * FROM orders""")
def s01a(spark, d):
    from tablight.sources import files
    path = _scratch(spark, "csv")
    tbl(spark, d, "orders").write.option("header", True).option("sep", ";").csv(path)
    return files.read_csv(spark, path).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@register("s02_json_read", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
c_mktsegment FROM customer""")
def s02(spark, d):
    from tablight.sources import files
    path = _scratch(spark, "json")
    tbl(spark, d, "customer").write.json(path)
    return files.read_json(spark, path)


@register("s04_s05_coerce", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, TRY_CAST(replace(replace(CAST(o_totalprice AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) AS price_text,
       o_orderstatus FROM orders""")
def s04(spark, d):
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"),
                                       F.regexp_replace(F.col("o_totalprice").cast("string"), "\\\\.", ",").alias("price_text"),
                                       "o_orderstatus")
    return SC.coerce(o)


@register("s06_parse_dates", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS d FROM orders""")
def s06(spark, d):
    o = tbl(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return SC.parse_dates(o, "d").withColumn("d", F.col("d").cast("timestamp_ntz"))


@register("s07_preview", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events)
WHERE rn % ((SELECT COUNT(*) FROM events) // 150) = 0 ORDER BY event_id LIMIT 150""")
def s07(spark, d):
    return SC.preview(tbl(spark, d, "events"), "event_id")


# ==========================================================================
# V: roles and definition audits
# ==========================================================================

_LAKE = ("orders", "customer", "lineitem", "events")


def _lake_profiles(spark, d) -> DataFrame:
    parts = []
    for t in _LAKE:
        parts.append(P.profile(tbl(spark, d, t)).withColumn("table", F.lit(t)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lake_cols_sql() -> str:
    names = ", ".join(f"'{t}'" for t in _LAKE)
    return f"""SELECT table_name AS "table", column_name AS "column",
  data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT', 'HUGEINT')
    OR data_type LIKE 'DECIMAL%' AS is_numeric,
  regexp_replace(lower(column_name), '[^a-z0-9]+', '', 'g') AS n
FROM information_schema.columns WHERE table_name IN ({names})"""


def _any_sql(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _type_sql(share: str) -> str:
    """The semantic type of name ``c`` by the rule table; ``share`` is SQL for
    its range rule."""
    from tablight.functions import keywords as KW
    return "CASE " + " ".join(f"WHEN {_any_sql('c', words)} AND {share if condition else 'TRUE'} THEN '{value}'"
                              for words, value, condition in KW.SEMANTIC_TYPE_RULES) + " ELSE 'raw_numeric' END"


def _averaged_sql() -> str:
    """Whether values of name ``c`` and type ``st`` must not be added up."""
    from tablight.functions import keywords as KW
    parts = []
    for words, types, condition in KW.AVERAGED_RULES:
        names = _any_sql("c", words) if words else "st IN (" + ", ".join(f"'{t}'" for t in types) + ")"
        parts.append(f"({names}" + (f" AND NOT {_any_sql('c', KW.TOTAL_OR_COUNT)})" if condition else ")"))
    return "(" + " OR ".join(parts) + ")"


def _classify_sql() -> str:
    from tablight.functions import keywords as KW
    doms = list(KW.DOMAIN_KEYWORDS.items())
    hits = ",\n  ".join(
        "(" + " + ".join(f"CAST(contains(names, '{k}') AS INTEGER)" for k in kws) + f") AS h{i}"
        for i, (_, kws) in enumerate(doms))
    best = " ".join(f"WHEN h{i} > 0 AND h{i} >= greatest({', '.join(f'h{j}' for j in range(len(doms)))}) "
                    + " ".join(f"AND h{i} > h{j}" for j in range(i)) + f" THEN '{dom}'"
                    for i, (dom, _) in enumerate(doms))
    role = "CASE " + " ".join(
        f"WHEN {'TRUE' if dom == 'any' else f'domain = {chr(39)}{dom}{chr(39)}'} AND {'is_numeric' if number else 'TRUE'} "
        f"AND {_any_sql('n', words)} THEN '{role}|{importance}|{agg}'"
        for dom, words, number, role, importance, agg in KW.ROLE_RULES) + " END"
    return f"""WITH c AS ({_lake_cols_sql()}),
t AS (SELECT "table", string_agg(n, ' ') AS names FROM c GROUP BY 1),
h AS (SELECT "table", {hits} FROM t),
dm AS (SELECT "table", COALESCE(CASE {best} END, 'general_business') AS domain FROM h),
r AS (SELECT c.*, dm.domain, {role} AS rr FROM c JOIN dm USING ("table"))
SELECT "table", "column", domain, split_part(rr, '|', 1) AS role, CAST(split_part(rr, '|', 2) AS INTEGER) AS importance,
       split_part(rr, '|', 3) AS aggregation FROM r"""


def _semantics_sql() -> str:
    from tablight.functions import keywords as KW
    c = "replace(replace(lower(column_name), '_', ''), ' ', '')"
    A = lambda ws: _any_sql("c", ws)
    st = _type_sql("FALSE")
    agg = f"CASE WHEN {_averaged_sql()} THEN 'mean' WHEN {A(KW.ADDED_NAMES)} THEN 'sum' ELSE 'mean' END"
    dirn = f"""CASE WHEN {A(KW.LOWER_IS_BETTER)} THEN 'lower_is_better'
  WHEN {A(KW.HIGHER_IS_BETTER)} THEN 'higher_is_better' ELSE 'neutral' END"""
    return f"""WITH b AS ({_lake_cols_sql()}),
x AS (SELECT "column", {c.replace("column_name", '"column"')} AS c FROM b WHERE is_numeric),
y AS (SELECT *, {st} AS st FROM x)
SELECT "column", st AS semantic_type, {agg} AS aggregation, {dirn} AS direction FROM y"""


@register("v01_classify", _classify_sql())
def v01(spark, d):
    return V.classify(_lake_profiles(spark, d)).drop("hints")


@register("v02_semantics", _semantics_sql())
def v02(spark, d):
    return V.semantics(_lake_profiles(spark, d))


def _defs_from_profile(prof: DataFrame) -> DataFrame:
    """Metric definitions derived from the data: every column proposed as a
    metric with a summed aggregation (what an unguided planner would say)."""
    return prof.select("column", F.lit("metric").alias("role"), F.lit(None).cast("string").alias("semantic_type"),
                       F.lit("total").alias("aggregation"), F.lit(None).cast("string").alias("direction"),
                       F.lit("high").alias("confidence"), F.lit(True).alias("include_as_kpi"),
                       F.lit(True).alias("include_in_clustering"))


def _audit_sql() -> str:
    from tablight.functions import keywords as KW
    prof = _profile_sql("lineitem", _LINEITEM)
    nums = ", ".join(f"('{c}', {str(t in ('bigint', 'int', 'double')).upper()})" for c, t in _LINEITEM)
    A = lambda ws: _any_sql("c", ws)
    st = _type_sql(f"(vmin >= 0 AND vmax <= 100 AND NOT {A(KW.TOTAL_OR_COUNT)})")
    repair = _averaged_sql()
    inf_agg = f"CASE WHEN {repair} THEN 'mean' WHEN {A(KW.ADDED_NAMES)} THEN 'sum' ELSE 'mean' END"
    dirn = f"""CASE WHEN {A(KW.LOWER_IS_BETTER)} THEN 'lower_is_better'
  WHEN {A(KW.HIGHER_IS_BETTER)} THEN 'higher_is_better' ELSE 'neutral' END"""
    safe = A(KW.METRIC_SAFE_TOKENS)
    return f"""WITH pr AS ({prof}),
ty AS (SELECT * FROM (VALUES {nums}) t(col, is_numeric)),
x AS (SELECT pr."column", ty.is_numeric, pr."min" AS vmin, pr."max" AS vmax,
             replace(replace(lower(pr."column"), '_', ''), ' ', '') AS c,
             pr.is_identifier FROM pr JOIN ty ON pr."column" = ty.col),
y AS (SELECT *, CASE WHEN {safe} THEN FALSE ELSE is_identifier END AS idl, {st} AS st FROM x),
z AS (SELECT *, {inf_agg} AS inf, {repair} AS rep, {dirn} AS dir FROM y)
SELECT "column", 'supporting_metric' AS role,
  CASE WHEN NOT is_numeric OR idl THEN 'raw_numeric' ELSE st END AS semantic_type,
  CASE WHEN NOT is_numeric OR idl THEN 'sum' WHEN rep THEN inf ELSE 'sum' END AS aggregation,
  CASE WHEN NOT is_numeric OR idl THEN 'neutral' ELSE dir END AS direction,
  (is_numeric AND NOT idl) AS include_as_kpi, (is_numeric AND NOT idl) AS include_in_clustering,
  CASE WHEN is_numeric AND NOT idl THEN 'backend_repaired' END AS aggregation_source,
  CASE WHEN NOT is_numeric OR idl THEN 'rejected' ELSE 'repaired' END AS validation_status,
  CASE WHEN NOT is_numeric THEN 'non_numeric_metric' WHEN idl THEN 'id_like_metric'
       ELSE concat_ws('; ', 'role_normalized', 'semantic_type_normalized', 'aggregation_normalized',
                      'direction_normalized',
                      CASE WHEN st <> 'raw_numeric' THEN 'semantic_type_inferred' END,
                      CASE WHEN rep THEN 'aggregation_repaired_to_' || inf END,
                      CASE WHEN dir <> 'neutral' THEN 'direction_repaired' END) END AS repair_reason
FROM z"""


@register("v03_audit_metrics", _audit_sql())
def v03(spark, d):
    prof = P.profile(tbl(spark, d, "lineitem"))
    return V.audit_metrics(_defs_from_profile(prof), prof)


def _analyses_from_profile(prof: DataFrame) -> DataFrame:
    """Analysis definitions built from the profiled columns: a mean bar of each
    numeric column by each other column, a count bar of each other column, a
    scatter of each numeric column against every column, and a clustering of
    all numeric columns."""
    spark = prof.sparkSession
    cols = prof.select("column", "is_numeric").collect()  # one row per column
    nums = [r["column"] for r in cols if r["is_numeric"]]
    dims = [r["column"] for r in cols if not r["is_numeric"]]
    charts = spark.createDataFrame(
        [(f"bar-{m}-{d}", "bar", "average", m, None, d, []) for m in nums for d in dims]
        + [(f"count-{d}", "bar", "count", None, None, d, []) for d in dims]
        + [(f"scatter-{m}-{c['column']}", "scatter", None, m, c["column"], None, []) for m in nums for c in cols],
        "id string, analysis_type string, aggregation string, metric string, second_metric string, "
        "dimension string, features array<string>")
    none = F.lit(None).cast("string")
    clus = prof.agg(F.collect_list(F.when(F.col("is_numeric"), F.col("column"))).alias("features")).select(
        F.lit("cluster-all").alias("id"), F.lit("cluster").alias("analysis_type"), none.alias("aggregation"),
        none.alias("metric"), none.alias("second_metric"), none.alias("dimension"), "features")
    return charts.unionByName(clus)


_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
           ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def _analysis_audit_sql() -> str:
    from tablight.functions import keywords as KW
    safe = "|".join(KW.METRIC_SAFE_TOKENS)
    nums = ", ".join(f"('{c}', {i}, {str(t in ('bigint', 'int', 'double')).upper()})" for i, (c, t) in enumerate(_ORDERS))
    return f"""WITH pr AS ({_profile_sql("orders", _ORDERS)}),
ty AS (SELECT * FROM (VALUES {nums}) t(col, pos, is_num)),
c AS (SELECT ty.col, ty.pos, ty.is_num,
             CASE WHEN regexp_matches(replace(replace(lower(ty.col), '_', ''), ' ', ''), '({safe})') THEN FALSE
                  ELSE pr.is_identifier END AS idl
      FROM ty JOIN pr ON pr."column" = ty.col),
bars AS (SELECT 'bar-' || m.col || '-' || d.col AS id, 'bar' AS analysis_type, 'mean' AS aggregation, m.col AS metric,
                NULL AS second_metric, d.col AS dimension, '' AS features, 'aggregation_normalized' AS issues,
                'repaired' AS validation_status
         FROM c m JOIN c d ON m.is_num AND NOT d.is_num
         UNION ALL SELECT 'count-' || col, 'bar', 'count', NULL, NULL, col, '', '', 'accepted' FROM c WHERE NOT is_num
         UNION ALL SELECT 'scatter-' || m.col || '-' || s.col, 'scatter', NULL, m.col, s.col, NULL, '',
                CASE WHEN s.is_num THEN '' ELSE 'second_metric_not_numeric' END,
                CASE WHEN s.is_num THEN 'accepted' ELSE 'rejected' END FROM c m JOIN c s ON m.is_num),
cl AS (SELECT string_agg(col, ',' ORDER BY pos) FILTER (WHERE is_num AND NOT idl) AS kept,
              COUNT(*) FILTER (WHERE is_num AND NOT idl) AS nk,
              COUNT(*) FILTER (WHERE is_num) - COUNT(*) FILTER (WHERE is_num AND NOT idl) AS dropped FROM c)
SELECT * FROM bars
UNION ALL
SELECT 'cluster-all', 'clustering', NULL, NULL, NULL, NULL, COALESCE(kept, ''),
       concat_ws(',', 'type_normalized', CASE WHEN dropped > 0 THEN 'features_filtered' END,
                      CASE WHEN nk < 2 THEN 'clustering_needs_two_features' END),
       CASE WHEN nk < 2 THEN 'rejected' ELSE 'repaired' END FROM cl"""


@register("v04_audit_analyses", _analysis_audit_sql())
def v04(spark, d):
    prof = P.profile(tbl(spark, d, "orders"))
    out = V.audit_analyses(_analyses_from_profile(prof), prof)
    # list columns shown as comma-joined text (stable to compare)
    return out.withColumn("features", F.concat_ws(",", "features")).withColumn("issues", F.concat_ws(",", "issues"))


@register("v05_audit_summary", "WITH a AS (" + _audit_sql() + """)
SELECT COUNT(*) AS metric_count, COUNT(*) FILTER (WHERE validation_status = 'accepted') AS accepted_metrics,
       COUNT(*) FILTER (WHERE validation_status = 'repaired') AS repaired_metrics,
       COUNT(*) FILTER (WHERE validation_status = 'rejected') AS rejected_metrics FROM a""")
def v05(spark, d):
    prof = P.profile(tbl(spark, d, "lineitem"))
    return V.audit_summary(V.audit_metrics(_defs_from_profile(prof), prof))


# ==========================================================================
# C: clustering
# ==========================================================================

_FEATS = ["l_quantity", "l_extendedprice", "l_discount"]
_SCALED_SQL = """WITH st AS (SELECT AVG(l_quantity) m0, stddev_pop(l_quantity) s0, AVG(l_extendedprice) m1,
                   stddev_pop(l_extendedprice) s1, AVG(l_discount) m2, stddev_pop(l_discount) s2 FROM lineitem
                   WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
sc AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_quantity - m0) / s0 AS l_quantity,
              (l_extendedprice - m1) / s1 AS l_extendedprice, (l_discount - m2) / s2 AS l_discount
       FROM lineitem, st WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL)"""


@register("c01_feature_check", """
SELECT * FROM (VALUES ('l_orderkey', 0, FALSE, 'id_like'), ('l_quantity', 1, TRUE, NULL),
                      ('l_returnflag', 2, FALSE, 'non_numeric'), ('nope', 3, FALSE, 'column_not_found'))
t("column", ord, ok, reason)""")
def c01(spark, d):
    return C.feature_check(tbl(spark, d, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag", "nope"])


@register("c03_standardise", _SCALED_SQL + """
SELECT l_orderkey, l_linenumber, ROUND(l_quantity, 6) AS l_quantity, ROUND(l_extendedprice, 6) AS l_extendedprice,
       ROUND(l_discount, 6) AS l_discount FROM sc""")
def c03(spark, d):
    return rnd(C.standardise(tbl(spark, d, "lineitem"), _FEATS, keep=["l_orderkey", "l_linenumber"]), 6)


@register("c04_kmeans", None)
def c04(spark, d):
    res = C.cluster(tbl(spark, d, "lineitem"), _FEATS)
    return res["sizes"]


@register("c06_cluster_sizes", """
WITH s AS (SELECT label, COUNT(*) size FROM embeddings GROUP BY 1)
SELECT label, size, ROUND(size * 100.0 / SUM(size) OVER (), 1) AS size_pct,
       (MIN(size) OVER () / MAX(size) OVER ()) < 0.15 AS imbalanced FROM s""")
def c06(spark, d):
    return C.cluster_sizes(tbl(spark, d, "embeddings"), "label")


@register("c08_davies_bouldin", _SCALED_SQL + """,
cen AS (SELECT l_returnflag, AVG(l_quantity) c0, AVG(l_extendedprice) c1, AVG(l_discount) c2 FROM sc GROUP BY 1),
s AS (SELECT sc.l_returnflag, AVG(sqrt(power(l_quantity - c0, 2) + power(l_extendedprice - c1, 2) + power(l_discount - c2, 2))) s
      FROM sc JOIN cen USING (l_returnflag) GROUP BY 1),
cs AS (SELECT * FROM cen JOIN s USING (l_returnflag)),
r AS (SELECT a.l_returnflag, MAX((a.s + b.s) / sqrt(power(a.c0 - b.c0, 2) + power(a.c1 - b.c1, 2) + power(a.c2 - b.c2, 2))) rmax
      FROM cs a JOIN cs b ON a.l_returnflag <> b.l_returnflag GROUP BY 1)
SELECT ROUND(AVG(rmax), 6) AS davies_bouldin, AVG(rmax) > 2 AS high_overlap FROM r""")
def c08(spark, d):
    sc = C.standardise(tbl(spark, d, "lineitem"), _FEATS, keep=["l_returnflag"])
    return rnd(C.davies_bouldin(sc, _FEATS, "l_returnflag"), 6)


@register("c09_cluster_profile", """
SELECT l_returnflag, ROUND(AVG(l_quantity), 2) AS l_quantity, ROUND(AVG(l_extendedprice), 2) AS l_extendedprice,
       ROUND(AVG(l_discount), 2) AS l_discount FROM lineitem GROUP BY 1""")
def c09(spark, d):
    return C.cluster_profile(tbl(spark, d, "lineitem"), _FEATS, "l_returnflag")


@register("c10_feature_ranking", """
WITH l AS (SELECT l_returnflag, 'l_quantity' AS "column", 0 AS ord, CAST(l_quantity AS DOUBLE) v FROM lineitem
           UNION ALL SELECT l_returnflag, 'l_extendedprice', 1, l_extendedprice FROM lineitem
           UNION ALL SELECT l_returnflag, 'l_discount', 2, l_discount FROM lineitem),
g AS (SELECT "column", quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3, AVG(v) center, stddev_samp(v) sd FROM l GROUP BY 1),
cm AS (SELECT l_returnflag, "column", ord, AVG(v) cv FROM l GROUP BY 1, 2, 3),
t AS (SELECT cm.*, ROUND((cv - center) / greatest(q3 - q1, COALESCE(sd, 0), 1e-9), 3) AS delta,
             CASE WHEN cv >= q3 THEN 'high' WHEN cv <= q1 THEN 'low' ELSE 'balanced' END AS level
      FROM cm JOIN g USING ("column"))
SELECT l_returnflag, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(delta) DESC, ord) AS INTEGER) AS "rank",
       "column", ROUND(cv, 2) AS value, level, delta, FALSE AS lower_is_better FROM t""")
def c10(spark, d):
    return C.feature_ranking(tbl(spark, d, "lineitem"), _FEATS, "l_returnflag")


@register("c11_top_categories", """
WITH c AS (SELECT c_nationkey, 'c_mktsegment' AS "column", trim(c_mktsegment) AS value, COUNT(*) AS "count"
           FROM customer WHERE NULLIF(trim(c_mktsegment), '') IS NOT NULL GROUP BY 1, 3),
t AS (SELECT *, SUM("count") OVER (PARTITION BY c_nationkey) tot,
             row_number() OVER (PARTITION BY c_nationkey ORDER BY "count" DESC, value) rk FROM c)
SELECT c_nationkey, "column", value, "count", ROUND("count" * 100.0 / tot, 1) AS pct FROM t WHERE rk <= 3""")
def c11(spark, d):
    return C.top_categories(tbl(spark, d, "customer"), ["c_name", "c_mktsegment"], "c_nationkey")


@register("c12_pca", None)
def c12(spark, d):
    sc = C.standardise(tbl(spark, d, "lineitem"), _FEATS, keep=["l_orderkey", "l_linenumber"])
    return rnd(C.project(sc, _FEATS, keep=["l_orderkey", "l_linenumber"]), 6)


# ==========================================================================
# Streaming form of the calendar trend
# ==========================================================================

@register("st01_windowed_means", """
SELECT date_trunc('day', ts) AS period_start, date_trunc('day', ts) + INTERVAL 1 DAY AS period_end,
       ROUND(AVG(value), 6) AS mean, COUNT(*) AS n, ROUND(SUM(value), 4) AS total
FROM events GROUP BY 1, 2""")
def st01(spark, d):
    from tablight.streaming.trends import run_to_table
    out = run_to_table(spark, d, "events", "ts", "value", "1 day")
    return out.select("period_start", "period_end", F.round("mean", 6).alias("mean"), "n",
                      F.round("total", 4).alias("total"))


# ==========================================================================
# Remaining rules registered on their own
# ==========================================================================

@register("p10_metric_safe_identifier", "WITH p AS (" + _profile_sql("customer", _CUSTOMER) + """)
SELECT "column", is_identifier,
       CASE WHEN regexp_matches(replace(replace(lower("column"), '_', ''), ' ', ''),
            '(grade|rating|score|attendance|hour|duration|time|revenue|sales|profit|cost|amount|quantity|volume)')
            THEN FALSE ELSE is_identifier END AS is_identifier_metric_safe FROM p""")
def p10(spark, d):
    return P.profile(tbl(spark, d, "customer")).select("column", "is_identifier", "is_identifier_metric_safe")


def _priority_sql(col: str) -> str:
    from tablight.functions import keywords as KW
    neg = "|".join(KW.NEGATIVE_PREFIXES)
    kw = "|".join(KW.DOMAIN_PRIORITY)
    low = f"lower({col})"
    return (f"CASE WHEN regexp_matches(replace(replace({low}, '_', ''), ' ', ''), '^({neg})') THEN -1 "
            f"WHEN regexp_matches({low}, '(^|[_\\s\\-]|[0-9])({kw})') THEN 1 ELSE 0 END")


@register("k02_domain_priority", f"""
SELECT column_name AS "column", {_priority_sql("column_name")} AS priority
FROM information_schema.columns WHERE table_name = 'orders'""")
def k02(spark, d):
    prof = P.profile(tbl(spark, d, "orders"))
    return prof.select("column", KP.domain_priority(F.col("column")).alias("priority"))


@register("k01_kpi_candidates", """
SELECT "column", priority FROM (
  SELECT 'l_linenumber' AS "column", 0 AS priority, COUNT(DISTINCT l_linenumber) AS nu FROM lineitem
  UNION ALL SELECT 'l_quantity', 0, COUNT(DISTINCT l_quantity) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 0, COUNT(DISTINCT l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', 0, COUNT(DISTINCT l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', 0, COUNT(DISTINCT l_tax) FROM lineitem) WHERE nu > 2""")
def k01(spark, d):
    return KP.kpi_candidates(P.profile(tbl(spark, d, "lineitem"))).select("column", "priority")


@register("k03_shortlist", "WITH cc AS (" + _central_sql(4) + """)
SELECT "column", CAST(row_number() OVER (ORDER BY centrality DESC,
       array_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber'], "column"))
       AS INTEGER) AS slot FROM cc""")
def k03(spark, d):
    return KP.shortlist(tbl(spark, d, "lineitem"), 4)


@register("c02_select_features", """
SELECT "column", CAST(row_number() OVER (ORDER BY v DESC, position) AS INTEGER) AS slot FROM (
  SELECT 'l_linenumber' AS "column", 3 AS position, var_samp(l_linenumber) v, COUNT(DISTINCT l_linenumber) nu FROM lineitem
  UNION ALL SELECT 'l_quantity', 4, var_samp(l_quantity), COUNT(DISTINCT l_quantity) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 5, var_samp(l_extendedprice), COUNT(DISTINCT l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', 6, var_samp(l_discount), COUNT(DISTINCT l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', 7, var_samp(l_tax), COUNT(DISTINCT l_tax) FROM lineitem) WHERE nu > 2
QUALIFY slot <= 4""")
def c02(spark, d):
    feats = C.select_features(tbl(spark, d, "lineitem"))
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(feats)], "column string, slot int")


@register("c05_elbow", None)
def c05(spark, d):
    sc = C.standardise(tbl(spark, d, "lineitem"), _FEATS)
    inertias, _ = C.kmeans_sweep(sc, _FEATS)
    return C.elbow(inertias)


@register("c07_silhouette", _SCALED_SQL + """,
lab AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS cl, row_number() OVER () AS rid FROM sc),
agg AS (SELECT cl, COUNT(*) AS n, AVG(l_quantity) m0, AVG(l_extendedprice) m1, AVG(l_discount) m2,
               AVG(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount) AS mq
        FROM lab GROUP BY cl),
d AS (SELECT p.cl AS own, a.cl AS other, a.n,
             (p.l_quantity * p.l_quantity + p.l_extendedprice * p.l_extendedprice + p.l_discount * p.l_discount)
             - 2 * (p.l_quantity * a.m0 + p.l_extendedprice * a.m1 + p.l_discount * a.m2) + a.mq AS msd, p.rid
      FROM lab p CROSS JOIN agg a),
s AS (SELECT rid,
             MAX(CASE WHEN own = other THEN CASE WHEN n > 1 THEN msd * n / (n - 1) END END) AS a,
             MIN(CASE WHEN own <> other THEN msd END) AS b,
             MAX(CASE WHEN own = other THEN n END) AS n_own
      FROM d GROUP BY 1)
SELECT ROUND(AVG(CASE WHEN n_own <= 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6)
       AS silhouette_sq FROM s""")
def c07(spark, d):
    sc = C.standardise(tbl(spark, d, "lineitem"), _FEATS, keep=["l_returnflag"])
    from pyspark.ml.feature import StringIndexer
    # labels = the return flag, indexed alphabetically (distributed fit on distinct values)
    labelled = StringIndexer(inputCol="l_returnflag", outputCol="cluster", stringOrderType="alphabetAsc") \
        .fit(sc).transform(sc)
    score = C.silhouette(labelled, _FEATS)
    return labelled.limit(1).select(F.round(F.lit(score), 6).alias("silhouette_sq"))


def queries() -> dict[str, Query]:
    from tablight.plans import extra  # noqa: F401  (registers its queries)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tablight.plans import extra  # noqa: F401
    return dict(ORACLE)

