"""End-to-end flows composed from the operators: the analyses a user runs
on one table (or several joined ones).  Each flow returns named DataFrames;
nothing is collected except the small per-column catalogues the flows branch
on (profile rows, test tables).

* ``ingest``     files -> typed, coerced, joined table (+ optional Parquet copy)
* ``dashboard``  profile -> roles -> KPI values/trends + top-k group summaries
* ``analytics``  KPIs, statistical tests and heuristic chart data
* ``forecast``   series, fits, backtests and Holt forecasts
* ``clusters``   features, k-means sweep, quality and profiles
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablight.operators import aggregates as A
from tablight.operators import cluster as C
from tablight.operators import joins as J
from tablight.operators import kpi as KP
from tablight.operators import profile as P
from tablight.operators import series as FS
from tablight.operators import stats as S
from tablight.sources import coerce as SC
from tablight.sources import files


def ingest(spark: SparkSession, paths: list[str], save_to: str | None = None,
           max_rows: int | None = None) -> DataFrame:
    """Read CSV / JSON / Parquet files, coerce identifiers and numeric text,
    join several tables on matching names (many-to-many rejected), and
    optionally write the result as Parquet."""
    frames = []
    for path in paths:
        low = path.lower()
        if low.endswith(".csv"):
            df = files.read_csv(spark, path)
        elif low.endswith(".json"):
            df = files.read_json(spark, path)
        else:
            df = files.load(spark, path)
        frames.append(SC.coerce(df))
    out = J.auto_join(frames, max_rows=max_rows)
    if save_to:
        files.save(out, save_to)
        out = files.load(spark, save_to)
    return out


def _roles(prof_rows: list) -> dict[str, list[str]]:
    metrics = [r["column"] for r in prof_rows
               if r["type"] in ("continuous_numeric", "discrete_numeric") and not r["is_identifier"]
               and r["nunique"] > 2]
    dims = [r["column"] for r in prof_rows
            if r["type"] == "categorical" and not r["is_identifier"] and 2 <= r["nunique"] <= 15]
    dates = [r["column"] for r in prof_rows if r["type"] == "datetime" and not r["is_identifier"]]
    return {"metrics": metrics, "dimensions": dims, "dates": dates}


def dashboard(df: DataFrame, key: str | None = None, k: int = 5) -> dict[str, DataFrame]:
    """Profile, pick KPI columns, compute KPI values (+ half-period trends when
    a date exists) and the top-k group summaries of the leading metrics."""
    prof = P.profile(df)
    rows = prof.collect()  # one row per column
    roles = _roles(rows)
    kpi_cols = [r["column"] for r in KP.shortlist(df, 4, prof).collect()]
    out: dict[str, DataFrame] = {"profile": prof}
    if kpi_cols:
        out["kpis"] = KP.kpi_values(df, kpi_cols)
        if roles["dates"] and key:
            out["kpi_trends"] = KP.kpi_trend(df, roles["dates"][0], kpi_cols, key)
    else:
        out["kpis"] = KP.record_count(df)
    if roles["dimensions"] and roles["metrics"]:
        out["group_summary"] = A.auto_summary(df, roles["dimensions"], roles["metrics"][:3], k)
    if roles["dates"] and roles["metrics"]:
        out["trends"] = {m: A.trend(df, roles["dates"][0], m) for m in roles["metrics"][:2]}
    return out


def analytics(df: DataFrame, advanced: bool = True, boxes: int | None = None) -> dict[str, DataFrame]:
    """KPIs plus, when ``advanced``, the statistical test families and the
    chart data behind them (histograms, category counts, boxes, cross-tabs)."""
    prof = P.profile(df)
    rows = prof.collect()
    roles = _roles(rows)
    out: dict[str, DataFrame] = {"profile": prof}
    kpi_cols = [r["column"] for r in KP.shortlist(df, 4, prof).collect()]
    out["kpis"] = KP.kpi_values(df, kpi_cols) if kpi_cols else KP.record_count(df)
    hist_ok = [r["column"] for r in A.histogram_ok(prof).where(F.col("histogram")).collect()
               if r["column"] in roles["metrics"]]
    out["histograms"] = A.histograms(df, hist_ok)  # one table for all columns
    out["categories"] = {c: A.category_counts(df, c) for c in roles["dimensions"]
                         if not any(r["column"] == c and r["dominant_flag"] for r in rows)}
    if not advanced:
        return out
    nums = roles["metrics"]
    cats = [c for c in roles["dimensions"] if any(r["column"] == c and r["nunique"] <= 10 for r in rows)]
    corr = S.spearman_tests(df, nums) if len(nums) >= 2 else None
    groups = S.group_tests(df, cats, nums) if cats and nums else None
    chi = S.dependencies(df, roles["dimensions"]) if len(roles["dimensions"]) >= 2 else None
    out.update({k: v for k, v in (("correlations", corr), ("group_tests", groups), ("dependencies", chi))
                if v is not None})
    if any(x is not None for x in (corr, groups, chi)):
        out["insights"] = S.rank_insights(corr, groups, chi)
    out["shape"] = S.shape(df, nums, S.shapiro(df, nums)) if nums else None
    if len(nums) >= 3:
        out["correlation_table"] = A.correlation_table(df, nums)
    if groups is not None:
        # strongest first; ``boxes`` None builds all of them
        sig = (groups.where(F.col("significant")).orderBy("p_value", "categorical_col", "numeric_col")
               .select("categorical_col", "numeric_col").collect())
        out["boxes"] = {(r["categorical_col"], r["numeric_col"]): A.box(df, r["categorical_col"], r["numeric_col"])
                        for r in sig[:boxes]}
    if chi is not None:
        out["crosstabs"] = {(r["col_a"], r["col_b"]): A.crosstab_pct(df, r["col_a"], r["col_b"])
                            for r in chi.select("col_a", "col_b").collect()}
    return out


def forecast(df: DataFrame, periods: int = 6) -> dict[str, DataFrame]:
    """Date column, regular series of the first two numeric columns, OLS
    fit, backtest flags, Holt forecast and its direction."""
    date = FS.date_column(df)
    if date is None:
        raise ValueError("no date column found")
    nums = [f.name for f in df.schema.fields if P.is_numeric_type(f.dataType)][:2]
    ser = FS.series(df, date, nums)
    hw = FS.holt(ser, periods)
    fc = hw.select("metric", F.posexplode("forecast").alias("step", "value"))
    return {"series": ser, "fit": FS.trend_fit(ser), "flags": FS.forecast_flags(ser), "holt": hw,
            "extrapolation": FS.extrapolate(ser, periods),
            "direction": FS.direction(fc, ["metric"], "step", "value")}


def clusters(df: DataFrame, features: list[str] | None = None, key: str | None = None) -> dict:
    """Feature choice, scaling, k-means sweep with elbow, sizes, quality,
    per-cluster profiles, feature rankings and dominant categories."""
    res = C.cluster(df, features, key)
    assigned, feats = res["assigned"], res["features"]
    text = [f.name for f in assigned.schema.fields if not P.is_numeric_type(f.dataType)]
    text = [c for c in text if not c.endswith("__raw")]
    original = assigned.select("cluster", *text, *[F.col(f"`{c}__raw`").alias(c) for c in feats])
    res.update({"profile": C.cluster_profile(original, feats), "rankings": C.feature_ranking(original, feats),
                "categories": C.top_categories(original, text), "projection": C.project(assigned, feats)})
    return res
