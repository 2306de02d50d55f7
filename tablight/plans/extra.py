"""More registered queries: sources, missing values, whole results of tests,
forecasts and clusters.  Same rules as ``registry``, whose dictionaries they join."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablight.functions import keywords as KW
from tablight.functions import tails
from tablight.operators import aggregates as A
from tablight.operators import cluster as C
from tablight.operators import kpi as KP
from tablight.operators import profile as P
from tablight.operators import series as FS
from tablight.operators import stats as S
from tablight.plans.registry import (_HIST_SQL, _MONTHLY_SQL, ORACLE, _chi_sql, _group_rank_sql, _priority_sql, _scratch, _shape_sql,
                                     _spearman_sql, _sweep_sql, register, rnd, tbl)
from tablight.sources import files

# ==========================================================================
# S: sources
# ==========================================================================


@register("s01_csv_documents", """SELECT * FROM documents""")
def s01d(spark, d):
    """Texts with line ends, delimiters and quotes, written and read whole."""
    path = _scratch(spark, "csv")
    docs = tbl(spark, d, "documents")
    docs.write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(spark, path).select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])


@register("s02_json_array", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
c_mktsegment FROM customer""")
def s02a(spark, d):
    """One pretty-printed array per part file, cut at its records by many tasks."""
    path = _scratch(spark, "json")
    rows = tbl(spark, d, "customer").select(F.to_json(F.struct("*")).alias("value"), F.spark_partition_id().alias("part"))
    # what a user has on disk: an array to a file
    lines = rows.groupBy("part").agg(F.concat(F.lit("[\n  "), F.array_join(F.collect_list("value"), ",\n  "), F.lit("\n]")).alias("value"))
    lines.select("value").write.text(path)
    return files.read_json(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


# ==========================================================================
# Missing values: NaN in every family, a fifth of the prices of orders
# ==========================================================================

_GAPS = ("(SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice) FROM orders) orders")


def _gaps_sql(name: str) -> str:
    """The SQL of a query over orders, over orders with gaps."""
    return re.sub(r"\bFROM orders\b", f"FROM {_GAPS}", ORACLE[name])


def _gaps(spark, d):
    return tbl(spark, d, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice")))


@register("k04_values_nan", f"""SELECT 'o_totalprice' AS "column", 'sum' AS aggregation, ROUND(SUM(o_totalprice), 2) AS value,
'Total O Totalprice' AS title FROM {_GAPS}""")
def k04n(spark, d):
    return rnd(KP.kpi_values(_gaps(spark, d), ["o_totalprice"]), 2)


@register("k05_trend_nan", _gaps_sql("k05_kpi_trend"))
def k05n(spark, d):
    t = KP.kpi_trend(_gaps(spark, d), "o_orderdate", ["o_totalprice"], "o_orderkey")
    return rnd(t, 6).withColumns({c: F.round(c, 4) for c in ("first_half_mean", "second_half_mean")})


@register("k06_plan_nan", f"""SELECT 1 AS slot, 'o_totalprice' AS "column", 'mean' AS aggregation,
ROUND(AVG(o_totalprice), 4) AS value FROM {_GAPS}""")
def k06n(spark, d):
    defs = spark.createDataFrame([("o_totalprice", "mean", "primary_metric", "accepted", 0)],
                                 "column string, aggregation string, role string, validation_status string, ord int")
    return rnd(KP.plan_kpis(_gaps(spark, d), defs), 4)


@register("a07_trend_nan", _gaps_sql("a07_trend_year"))
def a07n(spark, d):
    return rnd(A.trend(_gaps(spark, d), "o_orderdate", "o_totalprice"), 4)


@register("a07_trend_month", """
WITH o AS (SELECT * FROM orders WHERE o_orderdate < (SELECT MIN(o_orderdate) FROM orders) + INTERVAL 200 DAY),
b AS (SELECT date_trunc('month', o_orderdate) p, AVG(o_totalprice) m FROM o GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT date_trunc('month', MIN(o_orderdate)) FROM o),
                                      (SELECT date_trunc('month', MAX(o_orderdate)) FROM o), INTERVAL 1 MONTH)) p)
SELECT strftime(last_day(cal.p), '%Y-%m-%d') AS period, ROUND(COALESCE(b.m, 0), 4) AS o_totalprice
FROM cal LEFT JOIN b ON cal.p = b.p""")
def a07m(spark, d):
    """The half year after the first order: a span of months."""
    o = tbl(spark, d, "orders")
    first = o.agg(F.min("o_orderdate")).first()[0]
    return rnd(A.trend(o.where(F.col("o_orderdate") < F.lit(first) + F.expr("INTERVAL 200 DAYS")), "o_orderdate", "o_totalprice"), 4)


@register("a08_plan_nan", f"""SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM {_GAPS}
GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 5""")
def a08n(spark, d):
    return rnd(A.run_plan(_gaps(spark, d), "bar", "o_orderpriority", "o_totalprice", agg="sum"), 2)


@register("a16_box_nan", _gaps_sql("a16_box"))
def a16n(spark, d):
    return rnd(A.box(_gaps(spark, d), "o_orderpriority", "o_totalprice"), 4)


@register("a16_box_many_groups", """
SELECT CAST(l_partkey AS VARCHAR) AS "group", ROUND(MIN(l_extendedprice), 4) AS "min",
       ROUND(quantile_cont(l_extendedprice, 0.25), 4) AS q1, ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       ROUND(quantile_cont(l_extendedprice, 0.75), 4) AS q3, ROUND(MAX(l_extendedprice), 4) AS "max", COUNT(*) AS n
FROM lineitem WHERE l_partkey IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 3""")
def a16g(spark, d):
    return rnd(A.box(tbl(spark, d, "lineitem"), "l_partkey", "l_extendedprice", max_groups=2**31 - 1), 4)


@register("a23_summary_nan", _gaps_sql("a23_auto_summary"))
def a23n(spark, d):
    return rnd(A.auto_summary(_gaps(spark, d), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"],
                              aggs={"o_totalprice": "mean"}), 4)


@register("a25_group_pie_nan", f"""SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM {_GAPS}
GROUP BY 1 HAVING SUM(o_totalprice) IS NOT NULL""")
def a25n(spark, d):
    return rnd(A.group_query(_gaps(spark, d), "o_orderstatus", "o_totalprice", "pie"), 2)


@register("t03_missing_nan", f"""SELECT COUNT(*) AS total_rows, COUNT(o_totalprice) AS sample_size,
COUNT(*) - COUNT(o_totalprice) AS missing_dropped_count, ROUND((COUNT(*) - COUNT(o_totalprice)) / COUNT(*), 6) AS missing_ratio
FROM {_GAPS}""")
def t03n(spark, d):
    return rnd(S.missing_meta(_gaps(spark, d), ["o_totalprice", "o_orderstatus"]), 6)


@register("t05_spearman_nan", _spearman_sql(_GAPS, ["o_totalprice", "o_custkey"]).replace(
    "SELECT 'o_totalprice' AS col_a", "SELECT 'o_totalprice' AS col_a").replace("corr(", "ROUND(corr(").replace(
    ") AS r,", "), 6) AS r,"))
def t05n(spark, d):
    return rnd(S.spearman_matrix(_gaps(spark, d), ["o_totalprice", "o_custkey"]), 6)


@register("t07_kruskal_nan", _gaps_sql("t07_kruskal"))
def t07n(spark, d):
    t = S.group_tests(_gaps(spark, d), ["o_orderstatus"], ["o_totalprice"], posthoc=False)
    return rnd(t.select("statistic", "p_value", "group_count", "sample_size", "effect_size"), 6)


@register("t08_posthoc_nan", _gaps_sql("t08_posthoc"))
def t08n(spark, d):
    t = S.posthoc_all(_gaps(spark, d), "o_orderpriority", "o_totalprice")
    return t.select("group_a", "group_b", F.round("u", 4).alias("u"), F.round("effect_size", 6).alias("effect_size"),
                    F.round("median_diff", 4).alias("median_diff"))


@register("f03_series_nan", _gaps_sql("f03_series_month"))
def f03n(spark, d):
    return rnd(FS.series(_gaps(spark, d), "o_orderdate", ["o_totalprice"], freq="month"), 4)


@register("a12_histograms", " UNION ALL ".join(f"""SELECT '{c}' AS "column", * FROM (
{_HIST_SQL.replace("l_extendedprice", c)})""" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def a12s(spark, d):
    return A.histograms(tbl(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


# ==========================================================================
# T: p and q values, grades
# ==========================================================================

def _normal_tail(z: str) -> str:
    """P(Z > z) for z >= 0: one half less the density times the series of odd
    powers over double factorials."""
    return (f"greatest(0.0, 0.5 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(greatest({z}, 1e-300)) "
            f"- (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi())) FOR k IN range(0, 220)]))")


_PAIR_SQL = """
WITH g AS (SELECT o_orderpriority AS lvl, o_totalprice AS v FROM orders
           WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
lv AS (SELECT lvl, COUNT(*) n_g FROM g GROUP BY 1 HAVING COUNT(*) >= 5),
pr AS (SELECT a.lvl AS group_a, b.lvl AS group_b, a.n_g AS n_a, b.n_g AS n_b FROM lv a JOIN lv b ON a.lvl < b.lvl),
x AS (SELECT group_a, group_b, g.lvl, g.v FROM pr JOIN g ON g.lvl = pr.group_a OR g.lvl = pr.group_b),
r AS (SELECT group_a, group_b, lvl, COUNT(*) OVER (PARTITION BY group_a, group_b, v) AS t,
             rank() OVER (PARTITION BY group_a, group_b ORDER BY v)
             + (COUNT(*) OVER (PARTITION BY group_a, group_b, v) - 1) / 2.0 AS rk FROM x),
ra AS (SELECT group_a, group_b, SUM(rk) FILTER (lvl = group_a) R_a, SUM(t * t - 1.0) AS tie FROM r GROUP BY 1, 2),
u AS (SELECT pr.*, R_a - n_a * (n_a + 1) / 2.0 AS u, tie, (n_a + n_b)::DOUBLE AS n FROM pr JOIN ra USING (group_a, group_b)),
z AS (SELECT *, greatest(0.0, (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5)
             / sqrt(n_a * n_b / 12.0 * ((n + 1) - tie / (n * (n - 1))))) AS z FROM u),
p AS (SELECT *, least(1.0, 2 * """ + _normal_tail("z") + """) AS p FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY p) rk, COUNT(*) OVER () m FROM p)
SELECT group_a, group_b, ROUND(p, 6) AS p_value,
       ROUND(LEAST(1.0, MIN(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM o"""


@register("t08_posthoc_p_q", _PAIR_SQL)
def t08p(spark, d):
    t = S.posthoc_all(tbl(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return rnd(t.select("group_a", "group_b", "p_value", "q_value"), 6)


@register("t06_mann_whitney_p", _group_rank_sql("lineitem", "l_linestatus", "l_discount") + """,
u AS (SELECT MIN_BY(R, lvl) - MIN_BY(n_g, lvl) * (MIN_BY(n_g, lvl) + 1) / 2.0 AS u, MIN_BY(n_g, lvl)::DOUBLE AS a,
             MAX_BY(n_g, lvl)::DOUBLE AS b FROM rs),
z AS (SELECT u, greatest(0.0, (greatest(u, a * b - u) - a * b / 2 - 0.5)
             / sqrt(a * b / 12 * ((n + 1) - tie / (n * (n - 1.0))))) AS z FROM u, ties)
SELECT ROUND(u, 4) AS statistic, ROUND(least(1.0, 2 * """ + _normal_tail("z") + """), 6) AS p_value FROM z""")
def t06p(spark, d):
    t = S.group_tests(tbl(spark, d, "lineitem"), ["l_linestatus"], ["l_discount"], posthoc=False)
    return t.select(F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def _t_two_sided(t: str, dof: str) -> str:
    """P(|T| > t): one less the finite sum of powers of the cosine (even and odd
    degrees of freedom have their own)."""
    th = f"atan(abs({t}) / sqrt({dof}))"
    even = (f"sin({th}) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0) - 0.5 * ln(pi()) + 2 * k * ln(cos({th}))) "
            f"FOR k IN range(0, CAST({dof} / 2 AS BIGINT))])")
    odd = (f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum([exp(lgamma(k + 1.0) - lgamma(k + 1.5) + 0.5 * ln(pi()) "
           f"+ (2 * k + 1) * ln(cos({th}))) / 2 FOR k IN range(0, CAST(({dof} - 1) / 2 AS BIGINT))]), 0))")
    return f"greatest(0.0, 1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END)"


_P_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("t05_spearman_p_q", "WITH m AS (" + _spearman_sql("lineitem", _P_COLS) + """),
s AS (SELECT col_a, col_b, r, n, CAST(n - 2 AS BIGINT) AS dof, abs(r) * sqrt((n - 2) / ((1 - r) * (1 + r))) AS t FROM m),
p AS (SELECT *, """ + _t_two_sided("t", "dof") + """ AS p FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY p) rk, COUNT(*) OVER () m FROM p)
SELECT col_a, col_b, ROUND(p, 6) AS p_value, n AS sample_size,
       ROUND(LEAST(1.0, MIN(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value,
       ROUND(abs(r), 6) AS effect_size, CASE WHEN abs(r) >= 0.7 THEN 'very_strong' WHEN abs(r) >= 0.5 THEN 'strong'
         WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM o""")
def t05p(spark, d):
    t = S.spearman_tests(tbl(spark, d, "lineitem"), _P_COLS)
    return rnd(t.select("col_a", "col_b", "p_value", "q_value", "sample_size", "effect_size", "strength"), 6)


_NET = ("(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_discount FROM lineitem) x")


@register("a19_correlated_prices", f"""
WITH m AS ({_spearman_sql(_NET, ["l_quantity", "l_extendedprice", "net", "l_discount"])}),
t AS (SELECT col_a AS var_a, col_b AS var_b, ROUND(COALESCE(r, 0), 2) + 0.0 AS correlation, pair_pos FROM m)
SELECT var_a, var_b, correlation,
       CASE WHEN abs(correlation) >= 0.5 THEN 'strong' WHEN abs(correlation) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength
FROM t WHERE (SELECT MAX(abs(correlation)) FROM t) >= 0.5 ORDER BY abs(correlation) DESC, pair_pos LIMIT 12""")
def a19c(spark, d):
    li = tbl(spark, d, "lineitem").select("l_quantity", "l_extendedprice",
                                          (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_discount")
    return A.correlation_table(li, ["l_quantity", "l_extendedprice", "net", "l_discount"])


@register("t13_fisher_p", """
WITH c AS (SELECT COUNT(*) FILTER (quality = 0 AND toxic = 0) AS a, COUNT(*) FILTER (quality = 0 AND toxic = 1) AS b,
                  COUNT(*) FILTER (quality = 1 AND toxic = 0) AS c, COUNT(*) FILTER (quality = 1 AND toxic = 1) AS d
           FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
x AS (SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n FROM c),
h AS (SELECT a, k, exp(lgamma(r1 + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) + lgamma(n - r1 + 1) - lgamma(c1 - k + 1)
             - lgamma(n - r1 - c1 + k + 1) - lgamma(n + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1)) AS p
      FROM x, LATERAL (SELECT unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) AS k))
SELECT ROUND(SUM(p) FILTER (p <= (SELECT p FROM h WHERE k = a) * (1 + 1e-7)), 6) AS p_value FROM h""")
def t13p(spark, d):
    t = S.contingency_tests(tbl(spark, d, "labels").dropna(subset=["quality", "toxic"]).groupBy(
        F.col("quality").cast("string").alias("level_a"), F.col("toxic").cast("string").alias("level_b")).agg(
        F.count(F.lit(1)).alias("count")).withColumn("table", F.lit("labels")), ["table"])
    four = [F.col(c) for c in ("a", "b", "c", "d")]
    cells = tbl(spark, d, "labels").agg(*[F.count_if((F.col("quality") == q) & (F.col("toxic") == x)).cast("double").alias(n)
                                          for n, q, x in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))])
    exact = cells.select(tails.fisher_udf(*four).alias("p"))
    # the test takes the exact value only where an expected count is small
    row = t.select("method", "p_value").first()
    p = F.lit(row["p_value"]) if row and row["method"] == "fisher_exact" else F.col("p")
    return exact.select(F.round(p, 6).alias("p_value"))


@register("t16_graded_groups", "WITH s AS (" + _sweep_sql() + """),
x AS (SELECT *, CASE WHEN abs(effect_size) >= 0.5 THEN 'large' WHEN abs(effect_size) >= 0.3 THEN 'medium'
                     WHEN abs(effect_size) >= 0.1 THEN 'small' ELSE 'negligible' END AS label FROM s)
SELECT categorical_col, numeric_col, label AS effect_label, quality, ROUND(1 - p_value, 6) AS score,
       printf('%s, p=%.4f, %d groups, q=%.4f, effect=%.2f (%s)', test, p_value, group_count, q_value, effect_size, label) AS technical
FROM x""")
def t16(spark, d):
    t = S.group_tests(tbl(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], posthoc=False)
    return rnd(t.select("categorical_col", "numeric_col", "effect_label", "quality", "score", "technical"), 6)


# ==========================================================================
# F: fitted values, flags
# ==========================================================================

@register("f05_holt_fitted", _MONTHLY_SQL.replace("WITH s AS", "WITH RECURSIVE s AS") + """,
h(idx, l, b, fitted) AS (
  SELECT 0, (SELECT y FROM ser WHERE idx = 0), (SELECT y FROM ser WHERE idx = 1) - (SELECT y FROM ser WHERE idx = 0),
         (SELECT y FROM ser WHERE idx = 0)
  UNION ALL
  SELECT s.idx, 0.5 * s.y + 0.5 * (h.l + h.b), 0.3 * ((0.5 * s.y + 0.5 * (h.l + h.b)) - h.l) + 0.7 * h.b, h.l + h.b
  FROM h JOIN ser s ON s.idx = h.idx + 1)
SELECT 'o_totalprice' AS metric, period, ROUND(y, 4) AS y, ROUND(fitted, 4) AS fitted FROM h JOIN ser USING (idx)""")
def f05t(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    return rnd(FS.fitted_values(FS.holt(ser, 6, params=[(0.5, 0.3)])), 4)


@register("f07_forecast_flags", _MONTHLY_SQL + """,
n AS (SELECT COUNT(*) n, COALESCE(regr_r2(y, idx), 0) AS r2 FROM ser), h AS (SELECT n, greatest(2, least(6, n // 5)) AS hold FROM n),
fit AS (SELECT regr_slope(y, idx) b, regr_intercept(y, idx) a FROM ser, h WHERE idx < n - hold),
e AS (SELECT y, y - (a + b * idx) AS err FROM ser, h, fit WHERE idx >= n - hold),
m AS (SELECT ROUND(AVG(CASE WHEN abs(y) >= 1e-9 THEN abs(err / y) END) * 100, 3) AS mape FROM e)
SELECT 'o_totalprice' AS metric, n, ROUND(r2, 6) AS r2, mape,
       concat_ws(',', CASE WHEN mape > 30 THEN 'high_error' END, CASE WHEN r2 < 0.3 THEN 'low_r2' END,
                 CASE WHEN n < 8 THEN 'low_data' END) AS warnings FROM n, m""")
def f07f(spark, d):
    ser = FS.series(tbl(spark, d, "orders"), "o_orderdate", ["o_totalprice"], freq="month")
    t = FS.forecast_flags(ser).withColumn("warnings", F.concat_ws(",", "warnings"))
    return rnd(t.select("metric", "n", "r2", "mape", "warnings"), 6)


# ==========================================================================
# C: checks, elbow, silhouette, projection
# ==========================================================================

_CHECK = {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "price": "o_totalprice",
          "rare": "CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END",
          "often_missing": "CASE WHEN o_orderkey % 10 < 3 THEN o_totalprice END",
          "constant": "CASE WHEN o_orderkey > 0 THEN 5.0 END", "gain": "o_totalprice * 1.5"}


def _check_sql() -> str:
    cols = ", ".join(f"{e} AS \"{c}\"" for c, e in _CHECK.items())
    parts = [f"""SELECT '{c}' AS "column", {i} AS ord, {str(c != "o_orderstatus").upper()} AS num, COUNT("{c}") AS nn,
  COUNT(*) AS n, {f'stddev_samp("{c}")' if c != "o_orderstatus" else 'NULL::DOUBLE'} AS sd,
  regexp_matches('{c.replace("_", "")}', '(id|uuid|pk|fk|key|code|ref|hash)$') AS idl FROM f""" for i, c in enumerate(_CHECK)]
    return f"""WITH f AS (SELECT {cols} FROM orders), s AS ({" UNION ALL ".join(parts)}),
r AS (SELECT "column", ord, CASE WHEN NOT num THEN 'non_numeric' WHEN idl THEN 'id_like'
        WHEN nn < greatest(10, floor(n * 0.2)) THEN 'insufficient_non_null' WHEN 1 - nn / n > 0.6 THEN 'high_missing_rate'
        WHEN COALESCE(sd, 0) < 1e-6 THEN 'low_variance' END AS reason FROM s
      UNION ALL SELECT 'nowhere', {len(_CHECK)}, 'column_not_found')
SELECT "column", ord, reason IS NULL AS ok, reason FROM r"""


@register("c01_all_reasons", _check_sql())
def c01a(spark, d):
    f = tbl(spark, d, "orders").select(*[F.expr(e).cast("double" if c not in ("o_orderstatus", "o_orderkey") else
                                                        {"o_orderkey": "bigint"}.get(c, "string")).alias(c) for c, e in _CHECK.items()])
    return C.feature_check(f, [*_CHECK, "nowhere"])


@register("c05_elbow_bands", """
WITH b AS (SELECT k, CAST(least(floor((l_quantity - 1) * k / 50), k - 1) AS INTEGER) AS j, l_quantity AS v
           FROM lineitem, range(2, 6) t(k)),
i AS (SELECT k, SUM(power(v - m, 2)) AS inertia FROM (SELECT *, AVG(v) OVER (PARTITION BY k, j) AS m FROM b) GROUP BY k),
d AS (SELECT k, inertia, inertia - lead(inertia) OVER (ORDER BY k) AS delta FROM i),
s AS (SELECT k, delta - lead(delta) OVER (ORDER BY k) AS second, lead(k) OVER (ORDER BY k) AS next_k FROM d)
SELECT CAST(COALESCE(arg_max(next_k, second), 2) AS INTEGER) AS optimal_k FROM s WHERE second IS NOT NULL""")
def c05b(spark, d):
    """The elbow of splits of the quantities into 2 to 5 equal bands."""
    q = F.col("l_quantity")
    rows = tbl(spark, d, "lineitem").where(q.isNotNull()).select(q.alias("v"), F.explode(F.array(*map(F.lit, range(2, 6)))).alias("k"))
    bands = rows.withColumn("j", F.least(F.floor((F.col("v") - 1) * F.col("k") / 50), F.col("k") - 1))
    inertia = bands.groupBy("k", "j").agg((F.var_pop("v") * F.count("v")).alias("part")).groupBy("k").agg(
        F.sum("part").alias("inertia"))
    return C.elbow(inertia)


@register("c07_silhouette_euclidean", """
WITH st AS (SELECT AVG(l_discount) m0, stddev_pop(l_discount) s0, AVG(l_linenumber) m1, stddev_pop(l_linenumber) s1 FROM lineitem),
p AS (SELECT l_returnflag AS c, (l_discount - m0) / s0 AS x, (l_linenumber - m1) / s1 AS y, COUNT(*) AS w
      FROM lineitem, st GROUP BY 1, 2, 3),
n AS (SELECT c, SUM(w) AS n FROM p GROUP BY 1),
d AS (SELECT a.c, a.x, a.y, a.w, b.c AS other, SUM(b.w * sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS total
      FROM p a, p b GROUP BY ALL),
m AS (SELECT d.*, n.n, total / (CASE WHEN d.c = other THEN n.n - 1 ELSE n.n END) AS mean FROM d JOIN n ON n.c = d.other),
s AS (SELECT c, x, y, any_value(w) AS w, MAX(mean) FILTER (c = other) AS a, MIN(mean) FILTER (c <> other) AS b,
             MAX(n) FILTER (c = other) AS own FROM m GROUP BY 1, 2, 3),
f AS (SELECT SUM(w * CASE WHEN own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) / SUM(w) AS v FROM s)
SELECT ROUND(v, 6) AS silhouette, ROUND(v, 6) AS low, ROUND(v, 6) AS high,
       CASE WHEN v >= 0.7 THEN 'Strong' WHEN v >= 0.5 THEN 'Good' WHEN v >= 0.25 THEN 'Moderate' ELSE 'Weak' END AS band,
       v < 0.25 AS warning FROM f""")
def c07e(spark, d):
    """77 different points: every anchor stands for equal points, so the bound is zero."""
    sc = C.standardise(tbl(spark, d, "lineitem"), ["l_discount", "l_linenumber"], keep=["l_returnflag"])
    return rnd(C.silhouette_euclidean(sc, ["l_discount", "l_linenumber"], "l_returnflag"), 6)


def _pca_sql() -> str:
    """Two components by power iteration on the correlations, the second after
    taking the first away; signs by the largest loading."""
    f = ["price", "net", "l_discount"]
    cov = ", ".join(f"covar_pop({a}, {b}) AS c{i}{j}" for i, a in enumerate(f) for j, b in enumerate(f))
    mul = lambda m: ", ".join(f"({' + '.join(f'{m}{i}{j} * v{j}' for j in range(3))}) AS w{i}" for i in range(3))
    norm = "sqrt(w0 * w0 + w1 * w1 + w2 * w2)"
    sign = "CASE WHEN CASE WHEN abs(v0) >= abs(v1) AND abs(v0) >= abs(v2) THEN v0 WHEN abs(v1) >= abs(v2) THEN v1 ELSE v2 END < 0 THEN -1 ELSE 1 END"
    less = ", ".join(f"c{i}{j} - lam * e{i} * e{j} AS c{i}{j}" for i in range(3) for j in range(3))
    quad = " + ".join(f"e{i} * c{i}{j} * e{j}" for i in range(3) for j in range(3))

    def power(name: str, table: str, start: tuple) -> str:
        return f"""{name}(k, v0, v1, v2) AS (SELECT 0, {start[0]}, {start[1]}, {start[2]} UNION ALL
  SELECT k + 1, w0 / {norm}, w1 / {norm}, w2 / {norm} FROM (SELECT k, {mul("c")} FROM {name}, {table} WHERE k < 400))"""

    return f"""WITH RECURSIVE t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net,
  l_discount FROM lineitem),
st AS (SELECT AVG(price) m0, stddev_pop(price) s0, AVG(net) m1, stddev_pop(net) s1, AVG(l_discount) m2, stddev_pop(l_discount) s2 FROM t),
sc AS (SELECT l_orderkey, l_linenumber, (price - m0) / s0 AS price, (net - m1) / s1 AS net, (l_discount - m2) / s2 AS l_discount FROM t, st)""" + f""",
cv AS (SELECT {cov} FROM sc), {power("pw", "cv", ("0.6::DOUBLE", "0.5::DOUBLE", "0.3::DOUBLE"))},
e1 AS (SELECT v0 * {sign} AS e0, v1 * {sign} AS e1, v2 * {sign} AS e2 FROM pw WHERE k = 400),
l1 AS (SELECT {quad} AS lam FROM e1, cv), cw AS (SELECT {less} FROM cv, e1, l1),
{power("pv", "cw", ("0.1::DOUBLE", "0.2::DOUBLE", "0.9::DOUBLE"))},
e2 AS (SELECT v0 * {sign} AS f0, v1 * {sign} AS f1, v2 * {sign} AS f2 FROM pv WHERE k = 400)
SELECT l_orderkey, l_linenumber, ROUND(price * e0 + net * e1 + l_discount * e2, 4) AS x,
       ROUND(price * f0 + net * f1 + l_discount * f2, 4) AS y FROM sc, e1, e2"""


@register("c12_projection", _pca_sql())
def c12p(spark, d):
    li = tbl(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice")).withColumn(
        "net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    sc = C.standardise(li, ["price", "net", "l_discount"], keep=["l_orderkey", "l_linenumber"])
    return rnd(C.project(sc, ["price", "net", "l_discount"], keep=["l_orderkey", "l_linenumber"]), 4)


# ==========================================================================
# K: priorities that differ; streaming
# ==========================================================================

@register("k01_priorities", """
WITH f AS (SELECT o_totalprice AS total_revenue, o_totalprice * 0.1 AS unit_profit, o_custkey AS error_count,
                  o_custkey % 7 AS plain FROM orders)
SELECT 'total_revenue' AS "column", 1 AS priority, COUNT(DISTINCT total_revenue) > 2 AS many FROM f
UNION ALL SELECT 'unit_profit', 1, COUNT(DISTINCT unit_profit) > 2 FROM f
UNION ALL SELECT 'plain', 0, COUNT(DISTINCT plain) > 2 FROM f""")
def k01p(spark, d):
    f = tbl(spark, d, "orders").select(F.col("o_totalprice").alias("total_revenue"), (F.col("o_totalprice") * 0.1).alias("unit_profit"),
                                       F.col("o_custkey").alias("error_count"), (F.col("o_custkey") % 7).alias("plain"))
    return KP.kpi_candidates(P.profile(f)).select("column", "priority", (F.col("nunique") > 2).alias("many"))


@register("st02_closed_windows", """
SELECT * FROM (SELECT date_trunc('day', ts) AS period_start, date_trunc('day', ts) + INTERVAL 1 DAY AS period_end,
       ROUND(AVG(value), 6) AS mean, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE period_end <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)""")
def st02(spark, d):
    """Windows that the watermark has closed, each written once."""
    from tablight.streaming import trends
    out, _ = trends.closed_windows(trends.windowed_means(trends.file_stream(spark, f"{d}/events.parquet"), "ts", "value"))
    return out.select("period_start", "period_end", F.round("mean", 6).alias("mean"), "n", F.round("total", 4).alias("total"))


# ==========================================================================
# Rules and tests whose first query shows one branch only
# ==========================================================================

@register("t02_shape_with_p", "WITH z AS (" + _shape_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]) + """),
y AS (SELECT * REPLACE (CAST(CASE "column" WHEN 'l_quantity' THEN 0.2 WHEN 'l_discount' THEN 0.01 END AS DOUBLE) AS p_value) FROM z),
n AS (SELECT *, coalesce(p_value > 0.05 AND abs(skewness) < 0.75 AND outlier_ratio < 0.05, FALSE) AS normal FROM y)
SELECT "column", non_null, skewness, kurtosis, outlier_ratio, p_value, normal AND non_null >= 8 AS is_normal,
       CASE WHEN non_null < 8 THEN 'insufficient_data' WHEN normal THEN 'approximately_normal' ELSE shape END AS shape FROM n""")
def t02p(spark, d):
    p = spark.createDataFrame([("l_quantity", 0.2), ("l_discount", 0.01)], "column string, p_value double")
    return rnd(S.shape(tbl(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], p), 6)


_DEPENDENT = {"flag": "l_returnflag", "mixed": "CASE WHEN l_orderkey % 10 = 0 THEN 'A' ELSE l_returnflag END",
              "other": "CASE WHEN l_orderkey % 3 = 0 THEN 'q' ELSE l_returnflag END",
              "band": "CAST(CAST(floor((l_quantity - 1) / 17) AS BIGINT) AS VARCHAR)"}


def _dependent_sql() -> str:
    """Every pair of the four columns; all have an even number of degrees of freedom."""
    frame = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _DEPENDENT.items()) + " FROM lineitem) z"
    parts, names = [], list(_DEPENDENT)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            parts.append(f"""SELECT * FROM ({_chi_sql(frame, a, b)}
SELECT '{a}' AS col_a, '{b}' AS col_b, {len(parts)} AS pos, chi2, sqrt(chi2 / (n * (least(r, k) - 1))) AS v, n, sparse,
       exp(-chi2 / 2) * list_sum([power(chi2 / 2, j) / gamma(j + 1.0) FOR j IN range(0, CAST((r - 1) * (k - 1) / 2 AS BIGINT))]) AS p
FROM s, d)""")
    return "WITH t AS (" + " UNION ALL ".join(parts) + """),
f AS (SELECT * FROM t WHERE v >= 0.3), o AS (SELECT *, row_number() OVER (ORDER BY p, pos) rk, COUNT(*) OVER () m FROM f)
SELECT col_a, col_b, ROUND(chi2, 4) AS chi2, ROUND(v, 6) AS cramers_v, ROUND(p, 6) AS p_value,
       ROUND(LEAST(1.0, MIN(p * m / rk) OVER (ORDER BY p, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value,
       CASE WHEN v >= 0.5 THEN 'large' WHEN v >= 0.3 THEN 'medium' ELSE 'small' END AS effect_label FROM o"""


@register("t14_several_pairs", _dependent_sql())
def t14s(spark, d):
    f = tbl(spark, d, "lineitem").select(*[F.expr(e.replace("VARCHAR", "STRING")).alias(c) for c, e in _DEPENDENT.items()])
    t = S.dependencies(f, list(_DEPENDENT))
    return rnd(t.select("col_a", "col_b", F.round("chi2", 4).alias("chi2"), "cramers_v", "p_value", "q_value", "effect_label"), 6)


def _ranked_sql() -> str:
    words = " + ".join(f"0.2 * CAST(contains(lower(technical), '{w}') AS INTEGER)" for w in KW.INSIGHT_PRIORITY)
    label = lambda e: (f"CASE WHEN abs({e}) >= 0.5 THEN 'large' WHEN abs({e}) >= 0.3 THEN 'medium' "  # noqa: E731
                       f"WHEN abs({e}) >= 0.1 THEN 'small' ELSE 'negligible' END")
    return "WITH w AS (" + _sweep_sql() + f"""),
g AS (SELECT 'group_test' AS kind, 'group-' || categorical_col || '-' || numeric_col AS id, effect_size, q_value, quality, 1 - p_value AS score,
        printf('%s, p=%.4f, %d groups, q=%.4f, effect=%.2f (%s)', test, p_value, group_count, q_value, effect_size,
               {label("effect_size")}) AS technical FROM w),
c AS (SELECT * FROM ({_chi_sql("orders", "o_orderstatus", "o_orderpriority")}
      SELECT chi2, sqrt(chi2 / (n * (least(r, k) - 1))) AS v, n, sparse,
             exp(-chi2 / 2) * list_sum([power(chi2 / 2, j) / gamma(j + 1.0) FOR j IN range(0, CAST((r - 1) * (k - 1) / 2 AS BIGINT))]) AS p
      FROM s, d)),
x AS (SELECT 'chi' AS kind, 'chi-o_orderstatus-o_orderpriority' AS id, v AS effect_size, p AS q_value,
        CASE WHEN n >= 30 AND p < 0.01 AND v >= 0.5 AND NOT sparse > 0.2 THEN 'high' WHEN n >= 20 AND p < 0.05 AND v >= 0.3 THEN 'medium'
             WHEN p < 0.1 AND v >= 0.1 THEN 'low' ELSE 'exploratory' END AS quality, (1 - p) * (v + 0.1) AS score,
        printf('Chi-Square, p=%.4f, Cramér''s V=%.2f, q=%.4f, effect=%.2f (%s)', p, v, p, v, {label("v")}) AS technical FROM c),
a AS (SELECT * FROM g UNION ALL SELECT * FROM x)
SELECT kind, id, ROUND(effect_size, 6) AS effect_size, ROUND(q_value, 6) AS q_value, quality, technical, ROUND(score, 6) AS score,
       ROUND(score + {words} + CASE quality WHEN 'high' THEN 0.3 WHEN 'medium' THEN 0.2 WHEN 'low' THEN 0.1 ELSE 0 END, 6) AS priority
FROM a"""


@register("t18_ranked_findings", _ranked_sql())
def t18r(spark, d):
    o = tbl(spark, d, "orders")
    groups = S.group_tests(o, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], posthoc=False)
    chi = S.dependencies(o, ["o_orderstatus", "o_orderpriority"], min_v=0.0)
    return rnd(S.rank_insights(None, groups, chi).drop("summary_cols"), 6)


_NAMES = ["total_revenue", "error_count", "unit_profit", "plain", "net sales", "myrevenue"]


@register("k02_names", "SELECT name AS \"column\", " + _priority_sql("name").replace(
    "(^|[_\\s\\-]|[0-9])", "(^|[^a-z])") + " AS priority FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES)
    + "]) AS name FROM (SELECT COUNT(*) FROM orders))")
def k02n(spark, d):
    """The numbers of orders under names that show each rule."""
    o = tbl(spark, d, "orders").select(*[(F.col("o_totalprice") * (i + 1)).alias(n) for i, n in enumerate(_NAMES)])
    return P.profile(o).select("column", KP.domain_priority(F.col("column")).alias("priority"))
