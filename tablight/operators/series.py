"""Time series: date detection, regular series, trend fits, Holt smoothing,
extrapolation, backtests and direction (F1-F8).

Every operator takes optional ``by`` keys so many series are built and fitted
in one job.  A series has one row per period (years / months / weeks), so the
per-series arrays used by the Holt fold are bounded by the calendar, not by
the data volume.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.functions.missing import number
from tablight.operators.profile import is_numeric_type, is_temporal_type, parse_timestamp


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def date_evidence(df: DataFrame) -> DataFrame:
    """F1 as rows: position, column, non_blank, parsed (values that parse as
    dates), days (distinct ones, approximate) and is_date of every text column.
    A date column needs 4 parsed values of 25 (of fewer than 8 values half, and
    2 at least) and 2 distinct dates.  One aggregate over all text columns."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, non_blank long, parsed long, days long, is_date boolean")
    aggs = []
    for i, c in enumerate(text):
        p = parse_timestamp(_q(c))
        aggs += [F.count(F.when(F.trim(_q(c)) != "", 1)).alias(f"n{i}"), F.count(p).alias(f"p{i}"),
                 F.approx_count_distinct(p).alias(f"d{i}")]
    rows = df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("non_blank"),
                 F.col(f"p{i}").alias("parsed"), F.col(f"d{i}").alias("days")) for i, c in enumerate(text)])))
    n = F.col("non_blank")
    enough = F.greatest(F.lit(2.0), F.least(F.lit(4.0), F.floor(n / 2).cast("double")), n * 4 / 25)
    return rows.withColumn("is_date", (F.col("parsed") >= enough) & (F.col("days") >= 2))


def date_column(df: DataFrame) -> str | None:
    """first native date/time column; else the first text column that
    ``date_evidence`` takes for dates."""
    for f in df.schema.fields:
        if is_temporal_type(f.dataType):
            return f.name
    found = date_evidence(df).where("is_date").orderBy("position").first()
    return found["column"] if found else None


def frequency(df: DataFrame, date: str, by: list[str] | None = None) -> DataFrame:
    """span > 730 days -> year, > 60 -> month, else week (per series)."""
    by = by or []
    d = F.to_timestamp(_q(date))
    span = F.datediff(F.max(d), F.min(d))
    g = df.where(d.isNotNull())
    g = g.groupBy(*[_q(b) for b in by]) if by else g.groupBy()
    return g.agg(span.alias("span_days")).withColumn(
        "freq", F.when(F.col("span_days") > 730, "year").when(F.col("span_days") > 60, "month")
        .otherwise("week"))


def period_end(d: Column, freq: Column | str) -> Column:
    """Period label: Dec 31 / month end / Sunday week end."""
    f = F.lit(freq) if isinstance(freq, str) else freq
    day = F.to_date(d)
    return (F.when(f == "year", F.make_date(F.year(day), F.lit(12), F.lit(31)))
            .when(f == "month", F.last_day(day))
            .otherwise(F.next_day(F.date_sub(day, 1), "Sun")))


def series(df: DataFrame, date: str, metrics: list[str], by: list[str] | None = None,
           freq: str | None = None, min_points: int = 4) -> DataFrame:
    """mean per period (empty periods dropped) for every metric and
    series key; series with fewer than 4 points are dropped; NaN is missing.

    Output (long): [by...], metric, freq, period (date), y, idx (0-based)."""
    by = by or []
    d = F.to_timestamp(_q(date)) if not isinstance(df.schema[date].dataType, T.StringType) \
        else parse_timestamp(_q(date))
    base = df.select(*[_q(b) for b in by], d.alias("_d"), *[number(_q(m)).alias(f"m{i}")
                                                            for i, m in enumerate(metrics)])
    base = base.where(F.col("_d").isNotNull())
    if freq is None:
        fr = frequency(base.withColumnRenamed("_d", "_dd"), "_dd", by).select(*by, "freq")
        if by:
            # one row per series key: the planner broadcasts it only while it is small
            base = base.join(fr, by, "inner")
        else:
            base = base.withColumn("freq", F.lit(fr.collect()[0]["freq"]))
        fcol = F.col("freq")
    else:
        fcol = F.lit(freq)
        base = base.withColumn("freq", fcol)
    long = base.select(*by, "freq", period_end(F.col("_d"), F.col("freq")).alias("period"),
                       F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("v"))
                                          for i, m in enumerate(metrics)])))
    agg = (long.groupBy(*by, "metric", "freq", "period").agg(F.avg("v").alias("y"))
           .where(F.col("y").isNotNull()))
    # one row per period: each series window holds a calendar's worth of rows
    w = Window.partitionBy(*by, "metric").orderBy("period")
    out = (agg.withColumn("idx", F.row_number().over(w) - 1)
           .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by, "metric"))))
    return out.where(F.col("n") >= min_points).drop("n")


def trend_fit(ser: DataFrame, by: list[str] | None = None) -> DataFrame:
    """OLS of y on index 0..n-1 per series: slope, intercept, R^2."""
    keys = (by or []) + ["metric"]
    return ser.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "idx").alias("slope"),
        F.regr_intercept("y", "idx").alias("intercept"),
        F.coalesce(F.regr_r2("y", "idx"), F.lit(0.0)).alias("r2"),
        F.max("period").alias("last_period"), F.first("freq").alias("freq"))


def _future_date(last: Column, freq: Column, k: Column) -> Column:
    return (F.when(freq == "year", F.make_date(F.year(last) + k, F.lit(12), F.lit(31)))
            .when(freq == "month", F.last_day(F.add_months(last, k)))
            .otherwise(F.date_add(last, k * 7)))


def extrapolate(ser: DataFrame, h: int = 6, by: list[str] | None = None) -> DataFrame:
    """OLS forecast for h future periods with their period-end dates."""
    keys = (by or []) + ["metric"]
    fit = trend_fit(ser, by)
    return (fit.select(*keys, "n", "slope", "intercept", "last_period", "freq",
                       F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
            .select(*keys, "step",
                    _future_date(F.col("last_period"), F.col("freq"), F.col("step")).alias("period"),
                    (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast")))


def backtest(ser: DataFrame, by: list[str] | None = None) -> DataFrame:
    """holdout backtest (n >= 8, holdout max(2, min(6, n//5))): OLS on the
    training part, MAE / RMSE / MAPE (|y| < 1e-9 skipped), 3 dp."""
    keys = (by or []) + ["metric"]
    n = ser.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    s = (ser.join(n, keys).where(F.col("n") >= 8)
         .withColumn("holdout", F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.col("n") / 5)))))
    train = F.col("idx") < F.col("n") - F.col("holdout")
    fit = s.groupBy(*keys).agg(F.regr_slope(F.when(train, F.col("y")), F.when(train, F.col("idx"))).alias("b"),
                               F.regr_intercept(F.when(train, F.col("y")), F.when(train, F.col("idx"))).alias("a"))
    e = (s.join(fit, keys).where(~train)
         .withColumn("err", F.col("y") - (F.col("a") + F.col("b") * F.col("idx"))))
    ape = F.when(F.abs("y") >= 1e-9, F.abs(F.col("err") / F.col("y")))
    return e.groupBy(*keys).agg(
        F.first("holdout").cast("int").alias("holdout_points"),
        F.round(F.avg(F.abs("err")), 3).alias("mae"),
        F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 3).alias("rmse"),
        F.round(F.avg(ape) * 100, 3).alias("mape"))


def forecast_flags(ser: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F7 flags: high_error (MAPE > 30), low_r2 (R^2 < .3), low_data (n < 8)."""
    keys = (by or []) + ["metric"]
    fit = trend_fit(ser, by).select(*keys, "n", "r2")
    bt = backtest(ser, by)
    t = fit.join(bt, keys, "left")
    return t.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("mape") > 30, F.lit("high_error")),
        F.when(F.col("r2") < 0.3, F.lit("low_r2")),
        F.when(F.col("n") < 8, F.lit("low_data")))))


def direction(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """F8: up/down/stable of a short sequence (e.g. the forecast): relative
    change last vs first over max(|first|, |mean|, 1) >= 2 %, else the OLS
    slope * (n - 1) / baseline >= 1 %; fewer than 2 finite values -> stable."""
    v = F.col(value)
    ok = values.where(v.isNotNull() & ~F.isnan(v))
    g = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"), F.avg(value).alias("mean"),
        F.covar_pop(v, F.col(order)).alias("cov"), F.var_pop(F.col(order)).alias("var"))
    base = F.greatest(F.abs("first"), F.abs("mean"), F.lit(1.0))
    pct = (F.col("last") - F.col("first")) / base
    slope_ratio = F.when(F.col("var") > 0, F.col("cov") / F.col("var") * (F.col("n") - 1) / base)
    return g.withColumn("direction", F.when(F.col("n") < 2, "stable")
                        .when(F.abs(pct) >= 0.02, F.when(pct > 0, "upward").otherwise("downward"))
                        .when(F.abs(F.coalesce(slope_ratio, F.lit(0.0))) >= 0.01,
                              F.when(slope_ratio > 0, "upward").otherwise("downward"))
                        .otherwise("stable"))


def _holt_fold(alpha: Column, beta: Column, level: Column, trend: Column, keep: bool = False) -> Column:
    """One pass of the smoothing over a series' array ``ys`` from a level and
    trend before the first point: struct(l, b, sse) and, if kept, the one-step
    predictions as ``fit``."""
    start = F.struct(level.alias("l"), trend.alias("b"), F.lit(0.0).alias("sse"),
                     *([F.array().cast("array<double>").alias("fit")] if keep else []))

    def step(acc: Column, y: Column) -> Column:
        pred = acc["l"] + acc["b"]
        lv = alpha * y + (1 - alpha) * pred
        err = y - pred
        return F.struct(lv.alias("l"), (beta * (lv - acc["l"]) + (1 - beta) * acc["b"]).alias("b"),
                        (acc["sse"] + err * err).alias("sse"),
                        *([F.concat(acc["fit"], F.array(pred)).alias("fit")] if keep else []))

    return F.aggregate("ys", start, step)


def _holt_arrays(ser: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: its values and periods in order, and the bounds and
    grid of the search."""
    pts = F.sort_array(F.collect_list(F.struct("idx", "y", "period", "freq")))
    arr = ser.groupBy(*keys).agg(pts.alias("pts"))
    ys = F.transform("pts", lambda p: p["y"])
    return arr.select(*keys, ys.alias("ys"), F.transform("pts", lambda p: p["period"]).alias("periods"),
                      F.col("pts")[0]["freq"].alias("freq"))


#: Search of the smoothing parameters: a grid of both, then ROUNDS rounds of
#: trials around the best of each series, at steps that shrink by SHRINK.
GRID_POINTS, ROUNDS, SHRINK = 19, 60, 0.7


def holt(ser: DataFrame, h: int = 6, by: list[str] | None = None, grid: int = GRID_POINTS, rounds: int = ROUNDS,
         params: list[tuple[float, float]] | None = None) -> DataFrame:
    """Holt additive-trend smoothing per series, alpha, beta and the level
    and trend before the first point chosen by one-step SSE.

    All series are searched at once: one fold per trial over the series' array
    (bounded by the calendar).  First a fixed (alpha, beta) grid, from the level
    and trend that the first two points give; then rounds of trials around each
    series' best -- one step up or down in each of the four, and along the last
    round's move -- at steps that shrink when nothing is better.  The best so
    far is always among the trials, so the SSE never rises, and alpha and beta
    stay within (0, 1).  ``params`` replaces the search by given (alpha, beta)
    pairs.

    Output: keys, alpha, beta, level0, trend0 (before the first point), sse,
    level, trend (after the last), fitted (array of struct period, y, fitted) and
    forecast (array of h values).  A series is one row, its trials the columns of
    that row, so many series are searched side by side."""
    keys = (by or []) + ["metric"]
    arr = _holt_arrays(ser, keys)
    step = 1.0 / (grid + 1)
    pairs = params or [(a * step, b * step) for a in range(1, grid + 1) for b in range(1, grid + 1)]
    y0, y1 = F.col("ys")[0], F.col("ys")[1]
    trials = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"),
                                (y0 - (y1 - y0)).alias("level"), (y1 - y0).alias("trend")) for a, b in pairs])
    found = arr.withColumn("trials", trials).select(*arr.columns, _best_of(F.col("trials")).alias("best"))
    if params is None and rounds:
        found = found.mapInPandas(_refine(rounds), found.schema)
    b = F.col("best")
    last = _holt_fold(b["alpha"], b["beta"], b["level"], b["trend"], keep=True)
    out = found.withColumn("end", last).select(
        *keys, b["alpha"].alias("alpha"), b["beta"].alias("beta"), b["level"].alias("level0"), b["trend"].alias("trend0"),
        F.col("end.sse").alias("sse"), F.col("end.l").alias("level"), F.col("end.b").alias("trend"),
        F.zip_with(F.arrays_zip("periods", "ys"), F.col("end.fit"), lambda p, f: F.struct(
            p["periods"].alias("period"), p["ys"].alias("y"), f.alias("fitted"))).alias("fitted"))
    return out.withColumn("forecast", F.transform(F.sequence(F.lit(1), F.lit(h)),
                                                  lambda k: F.col("level") + k * F.col("trend")))


_BEST = "struct<sse: double, alpha: double, beta: double, level: double, trend: double>"


def _best_of(trials: Column) -> Column:
    """The trial with the smallest SSE (ties: the smallest parameters)."""
    scored = F.transform(trials, lambda t: F.struct(
        _holt_fold(t["alpha"], t["beta"], t["level"], t["trend"])["sse"].alias("sse"), t["alpha"].alias("alpha"),
        t["beta"].alias("beta"), t["level"].alias("level"), t["trend"].alias("trend")))
    return F.array_min(scored).cast(_BEST)


def _refine(rounds: int):
    """Pattern search around each series' best, all trials of a round at once."""

    def sse(ys: np.ndarray, p: np.ndarray) -> np.ndarray:
        level, trend, total = p[:, 2].copy(), p[:, 3].copy(), np.zeros(len(p))
        for y in ys:
            pred = level + trend
            new = p[:, 0] * y + (1 - p[:, 0]) * pred
            trend = p[:, 1] * (new - level) + (1 - p[:, 1]) * trend
            total += (y - pred) ** 2
            level = new
        return total

    def search(ys: np.ndarray, best: dict) -> dict:
        names = ("alpha", "beta", "level", "trend")
        at, low = np.array([best[n] for n in names]), best["sse"]
        spread = float(np.std(ys)) or 1.0
        size, move = np.array([0.05, 0.05, spread / 2, spread / 4]), np.zeros(4)
        for _ in range(rounds):
            trials = np.concatenate([at + s * np.diag(size) for s in (1, -1, 0.5, -0.5)] + [at + [move], at + [2 * move]])
            trials[:, :2] = np.clip(trials[:, :2], 1e-4, 1 - 1e-4)
            got = sse(ys, trials)
            k = int(got.argmin())
            if got[k] < low:
                move, at, low = trials[k] - at, trials[k], float(got[k])
            else:
                size, move = size * SHRINK, np.zeros(4)
        return {"sse": low, **dict(zip(names, at.tolist(), strict=True))}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["best"] = [search(np.asarray(ys, float), dict(b)) for ys, b in zip(pdf["ys"], pdf["best"], strict=True)]
            yield pdf

    return work


def fitted_values(smoothed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F5 as rows: every period of every series with its value and the one-step
    fitted value."""
    return smoothed.select(*(by or []), "metric", F.inline("fitted"))


def forecast(df: DataFrame, periods: int = 6, date: str | None = None,
             metrics: list[str] | None = None) -> DataFrame:
    """Forecast report: for the first 2 numeric columns, the period series,
    OLS fit, backtest, warnings, Holt forecast and its direction."""
    date = date or date_column(df)
    if date is None:
        raise ValueError("no date column found")
    metrics = metrics or [f.name for f in df.schema.fields if is_numeric_type(f.dataType)][:2]
    ser = series(df, date, metrics)
    flags = forecast_flags(ser)
    hw = holt(ser, periods)
    fc = hw.select("metric", F.posexplode("forecast").alias("step", "value"))
    dirn = direction(fc, ["metric"], "step", "value").select("metric", "direction")
    return (flags.join(hw.select("metric", "alpha", "beta", "forecast"), "metric", "left")
            .join(dirn, "metric", "left"))
