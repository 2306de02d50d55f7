"""Clustering (C1-C12) with DataFrame-side quality measures.

Scaling uses population standard deviation (literals from one aggregate).
The k-means sweep runs all (k, restart) pairs together, one pass over the
points per Lloyd iteration with per-partition partial sums (MLlib KMeans is
an option).  Every quality/profile measure is a groupBy or a join against
the k centroids (k <= 5 rows, broadcast).  No step pairs points with points.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablight.functions.ordering import top_k_per_group
from tablight.functions.selection import quantiles
from tablight.operators.profile import is_numeric_type, profile

# FIXED VALUES: lower-is-better name fragments and category-like column names
LOWER_IS_BETTER_PATTERNS = [
    "minutesperscore", "minutespergoal", "scoringfrequency", "delay", "error", "defect", "risk",
    "cost", "mortality", "readmission", "complication", "churn", "dropout", "default",
    "defaultrate", "npl", "fraud", "debt", "downtime", "rejectrate", "reject", "waste", "loss",
    "failure", "complaint", "recency",
]
CATEGORY_CANDIDATE_PATTERNS = [
    "product", "productname", "category", "retailer", "retailername", "region", "state", "city",
    "teamname", "team", "position", "playerposition", "department", "segment", "diagnosis",
    "industry", "country", "channel", "branch", "status", "plan", "tier", "customersegment",
    "employeelevel", "jobrole", "clinic", "hospital", "treatment", "carrier", "warehouse",
    "supplier", "device", "machine", "line", "shift",
]
MIN_NON_NULL, MIN_NON_NULL_FRAC, MAX_MISSING_RATE, MIN_STD = 10, 0.20, 0.60, 1e-6


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _norm(name: str) -> str:
    return "".join(ch for ch in str(name).lower() if ch.isalnum())


def feature_check(df: DataFrame, cols: list[str], prof: DataFrame | None = None) -> DataFrame:
    """Per candidate feature, ok flag and rejection reason (in order:
    column_not_found, non_numeric, id_like, insufficient_non_null,
    high_missing_rate, low_variance)."""
    spark = df.sparkSession
    prof = prof if prof is not None else profile(df.select(*[_q(c) for c in cols if c in df.columns]))
    cand = spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "column string, ord int")
    p = cand.join(prof, "column", "left")
    need = F.greatest(F.lit(MIN_NON_NULL), F.floor(F.col("n_rows") * MIN_NON_NULL_FRAC))
    miss = 1 - F.col("non_null") / F.col("n_rows")
    reason = (F.when(F.col("position").isNull(), "column_not_found")
              .when(~F.col("is_numeric"), "non_numeric")
              .when(F.col("is_identifier"), "id_like")
              .when(F.col("non_null") < need, F.lit("insufficient_non_null"))
              .when(miss > MAX_MISSING_RATE, "high_missing_rate")
              .when(F.coalesce(F.col("stddev"), F.lit(0.0)) < MIN_STD, "low_variance"))
    return p.select("column", "ord", reason.isNull().alias("ok"), reason.alias("reason")).orderBy("ord")


def select_features(df: DataFrame, plan_features: list[str] | None = None, top: int = 4) -> list[str]:
    """Plan features that pass C1 (if >= 2), else the 4 highest-variance
    non-identifier numeric columns with > 2 distinct values."""
    prof = profile(df)
    if plan_features:
        ok = [r["column"] for r in feature_check(df, plan_features, prof).collect() if r["ok"]]
        if len(ok) >= 2:
            return ok
    rows = (prof.where(F.col("is_numeric") & ~F.col("is_identifier") & (F.col("nunique") > 2)
                       & F.col("variance").isNotNull())
            .orderBy(F.col("variance").desc(), "position").limit(top).collect())
    return [r["column"] for r in rows]


def standardise(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Complete rows, each feature as (x - mean) / population std."""
    keep = keep or []
    base = df.select(*[_q(c) for c in keep], *[_q(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    st = base.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    out = []
    for i, c in enumerate(cols):
        s = st[f"s{i}"] or 0.0
        out.append(((_q(c) - F.lit(st[f"m{i}"])) / F.lit(s if s > 0 else 1.0)).alias(c))
    return base.select(*[_q(k) for k in keep], *out)


def _vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def _kmeanspp(X, weight, k: int, rng) -> "np.ndarray":
    """Greedy k-means++ seeding (2 + log k local trials) on weighted points."""
    import numpy as np
    trials = 2 + int(np.log(k))
    base = weight / weight.sum()
    centers = [X[rng.choice(len(X), p=base)]]
    d2 = ((X - centers[0]) ** 2).sum(1)
    for _ in range(1, k):
        mass = weight * d2
        cand = rng.choice(len(X), size=trials, p=mass / mass.sum() if mass.sum() > 0 else base)
        cd2 = np.minimum(d2[None, :], ((X[None, :, :] - X[cand][:, None, :]) ** 2).sum(2))
        best = (cd2 * weight).sum(1).argmin()
        centers.append(X[cand[best]])
        d2 = cd2[best]
    return np.array(centers)


def _spread_points(pts: DataFrame, d: int, rounds: int, per_round: int, seed: int):
    """Candidates for centres from all points, and the rows nearest to each.

    Oversampling in rounds: each draws ``per_round`` points, without replacement,
    with a chance that grows with their weight times their squared distance from
    the candidates so far (the smallest exponential keys of that rate, so no
    total is needed first).  Every task keeps its own smallest keys; at most
    rounds x per_round points reach the driver."""
    import numpy as np
    import pandas as pd
    x = [f"x{i}" for i in range(d)]
    sc = pts.sparkSession.sparkContext
    found = np.empty((0, d))
    schema = ", ".join(f"{c} double" for c in x) + ", key double"
    for r in range(rounds):
        sent = sc.broadcast(found)

        def keyed(batches, sent=sent):
            for pdf in batches:
                X, w = pdf[x].to_numpy(float), pdf["w"].to_numpy(float)
                rate = w * (_nearest(X, sent.value)[1] if len(sent.value) else 1.0)
                out = pdf[x].copy()
                with np.errstate(divide="ignore"):
                    out["key"] = np.where(rate > 0, -np.log(pdf["u"].to_numpy(float)) / rate, np.inf)
                out = out[np.isfinite(out["key"])]
                yield out.nsmallest(per_round if r else 1, "key")

        u = (F.shiftrightunsigned(F.xxhash64(*x, F.lit(seed + r)), 11) + F.lit(0.5)) / float(2 ** 53)
        drawn = pts.withColumn("u", u).mapInPandas(keyed, schema).orderBy("key", *x).limit(per_round if r else 1).collect()
        sent.unpersist()
        if not drawn:
            break
        found = np.concatenate([found, np.array([row[:d] for row in drawn], dtype=float)])
    sent = sc.broadcast(found)

    def shares(batches):
        for pdf in batches:
            at = _nearest(pdf[x].to_numpy(float), sent.value)[0]
            n = np.bincount(at, pdf["w"].to_numpy(float), len(sent.value))
            yield pd.DataFrame({"at": np.flatnonzero(n), "w": n[n > 0]})

    weight = np.zeros(len(found))
    if len(found):
        for row in pts.mapInPandas(shares, "at int, w double").groupBy("at").agg(F.sum("w")).collect():
            weight[row[0]] = row[1]
    sent.unpersist()
    return found, weight


def _nearest(X, C):
    """For each point the nearest of the centres and its squared distance."""
    import numpy as np
    at, best = np.zeros(len(X), int), np.full(len(X), np.inf)
    half = (C * C).sum(1) / 2
    for lo in range(0, len(X), 1024):
        part = X[lo:lo + 1024]
        near = (half - part @ C.T).argmin(1)
        at[lo:lo + 1024] = near
        best[lo:lo + 1024] = ((part - C[near]) ** 2).sum(1)
    return at, best


#: Points of a packed block, and of one of its cells.
BLOCK, CELL = 1 << 19, 64


def _block(X, w) -> dict:
    """Points packed into one row: neighbours lie together in cells, each with
    its box, weight, mean and weighted squares about the mean."""
    import numpy as np
    n, d = X.shape
    sides = max(1, round((n / CELL) ** (1 / d)))
    cell = np.zeros(n, np.int64)
    for i in range(d):  # every slab is cut along the next axis
        order = np.lexsort((X[:, i], cell))
        X, w, cell = X[order], w[order], cell[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, n])
        cell = cell * sides + (np.arange(n) - np.repeat(starts, sizes)) * sides // np.repeat(sizes, sizes)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, n])
    weight = np.add.reduceat(w, starts)
    mean = np.add.reduceat(X * w[:, None], starts) / weight[:, None]
    own = (((X - np.repeat(mean, sizes, axis=0)) ** 2).sum(1)) * w
    stats = np.column_stack([np.minimum.reduceat(X, starts), np.maximum.reduceat(X, starts), mean, weight,
                             np.add.reduceat(own, starts)])
    return {"x": X.tobytes(), "w": w.tobytes(), "sizes": sizes.astype(np.int64).tobytes(), "stats": stats.tobytes()}


def _packed_points(pts: DataFrame, d: int) -> DataFrame:
    """The weighted points as a row per ``BLOCK`` of them, see ``_block``."""
    import numpy as np
    import pandas as pd
    x = [f"x{i}" for i in range(d)]

    def pack(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf[[*x, "w"]].to_numpy(float))
            n += len(pdf)
            if n >= BLOCK:
                rows = np.concatenate(held)
                yield pd.DataFrame([_block(rows[:, :d], rows[:, d])])
                held, n = [], 0
        if n:
            rows = np.concatenate(held)
            yield pd.DataFrame([_block(rows[:, :d], rows[:, d])])

    return pts.select(*x, "w").mapInPandas(pack, "x binary, w binary, sizes binary, stats binary")


def _whole_cells(stats, C):
    """Squared distances of the cells' means from the centres, and which cells
    have their whole box on one centre's side of every other."""
    import numpy as np
    k, d = C.shape
    lo, hi, mean = stats[:, :d], stats[:, d:2 * d], stats[:, 2 * d:3 * d]
    d2 = np.stack([((mean - c) ** 2).sum(1) for c in C], 1)
    near = d2.argmin(1)
    whole = np.ones(len(near), bool)
    for j in range(k):
        # the corner of the box that is furthest towards centre j
        corner = np.where(C[j] > C[near], hi, lo)
        gap = ((corner - C[j]) ** 2).sum(1) - ((corner - C[near]) ** 2).sum(1)
        whole &= (near == j) | (gap > 1e-9 * (1 + (corner * corner).sum(1)))
    return d2, whole


def _block_sums(X, w, sizes, stats, C):
    """Weight, sum of squared distances and sums of the points nearest to each
    centre.  Cells that belong to one centre count as a whole; only the points
    of the others are looked at."""
    import numpy as np
    k, d = C.shape
    mean, weight, own = stats[:, 2 * d:3 * d], stats[:, -2], stats[:, -1]
    d2, whole = _whole_cells(stats, C)
    near = d2.argmin(1)
    at, wt = near[whole], weight[whole]
    cost = own[whole] + wt * d2[whole, at]
    cnt, sse = np.bincount(at, wt, k), np.bincount(at, cost, k)
    sums = np.stack([np.bincount(at, wt * mean[whole, i], k) for i in range(d)], 1)
    if not whole.all():
        rest = np.repeat(~whole, sizes)
        P, pw = X[rest], w[rest]
        best, lab = ((P - C[0]) ** 2).sum(1), np.zeros(len(P), np.int64)
        for j in range(1, k):  # ties to the lower index
            dj = ((P - C[j]) ** 2).sum(1)
            closer = dj < best
            lab[closer] = j
            np.minimum(best, dj, out=best)
        cnt, sse = cnt + np.bincount(lab, pw, k), sse + np.bincount(lab, best * pw, k)
        sums = sums + np.stack([np.bincount(lab, pw * P[:, i], k) for i in range(d)], 1)
    return cnt, sse, sums


def _seeded(found, weight, k: int, rng, trials: int = 12):
    """Centres for one run: the best of a few weighted k-means++ starts, each
    settled on the weighted candidates."""
    import numpy as np
    best, cost = None, np.inf
    for _ in range(trials):
        C = _kmeanspp(found, weight, k, rng)
        for _ in range(50):
            at, _ = _nearest(found, C)
            n = np.bincount(at, weight, len(C))
            new = np.stack([np.bincount(at, weight * found[:, i], len(C)) for i in range(found.shape[1])], 1)
            new = np.where(n[:, None] > 0, new / np.maximum(n, 1e-300)[:, None], C)
            if np.allclose(new, C):
                break
            C = new
        now = float((weight * _nearest(found, C)[1]).sum())
        if now < cost:
            best, cost = C, now
    return best


def kmeans_sweep(scaled: DataFrame, cols: list[str], max_k: int = 5, n_init: int = 10,
                 seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
                 rounds: int = 6, per_round: int = 64, engine: str = "batched") -> tuple[DataFrame, dict]:
    """C4: k = 2..min(5, n//2), ``n_init`` restarts per k, lowest inertia kept.

    ``batched`` (default) runs Lloyd's algorithm for every (k, restart) at
    once: each iteration is one pass over packed blocks of points in which every
    task assigns its points for all runs with numpy, whole cells of a block at a
    time where a cell lies within one cluster, and emits only per-cluster partial
    sums; a groupBy adds them up (at most runs x k rows) and the new centres go
    back as a broadcast literal.  Equal points are one weighted point throughout;
    runs that start from the same centres are one run.  Seeds come from ``rounds`` oversampling passes over all
    points (``per_round`` candidates each, ``_spread_points``) and weighted
    k-means++ on the candidates.  ``mllib`` fits ``pyspark.ml`` KMeans per restart.
    Returns (k, inertia) and the chosen centres by k (numpy arrays)."""
    import numpy as np
    import pandas as pd
    from tablight.functions.partitioning import spread

    spark = scaled.sparkSession
    pts = spread(scaled.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
                 ).groupBy(*[f"x{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).alias("w")).persist()
    n = pts.agg(F.sum("w")).first()[0] or 0
    ks = list(range(2, min(max_k, n // 2) + 1))
    if engine == "mllib":
        return _kmeans_mllib(pts, cols, ks, n_init, seed, max_iter)
    d = len(cols)
    if not ks:
        pts.unpersist()
        return spark.createDataFrame([], "k int, inertia double"), {}
    found, weight = _spread_points(pts, d, rounds, per_round, seed)
    m = {f"x{i}": F.sum(F.col(f"x{i}") * F.col("w")) / F.sum("w") for i in range(d)}
    mean = pts.agg(*[v.alias(c) for c, v in m.items()]).first()
    var = pts.agg(*[(F.sum(F.pow(F.col(f"x{i}") - F.lit(mean[f"x{i}"]), 2) * F.col("w")) / F.sum("w")).alias(f"v{i}")
                    for i in range(d)]).first()
    tol_abs = tol * float(np.mean([var[f"v{i}"] or 0.0 for i in range(d)]))
    runs = {}
    for k in ks:
        for r in range(n_init):
            runs[(k, r)] = _seeded(found, weight, k, np.random.default_rng(seed + 1000 * k + r))
    # runs that start from the same centres are one run
    same = {}
    for key, c in runs.items():
        same.setdefault((key[0], c[np.lexsort(c.T)].tobytes()), key)
    runs = {key: runs[key] for key in same.values()}
    blocks = _packed_points(pts, d).persist()
    schema = "k int, run int, j int, cnt double, sse double, " + ", ".join(f"s{i} double" for i in range(d))

    def one_pass(centres: dict) -> dict:
        bc = spark.sparkContext.broadcast(centres)

        def partial(it):
            for pdf in it:
                rows = []
                for x, w, sizes, stats in zip(pdf["x"], pdf["w"], pdf["sizes"], pdf["stats"], strict=True):
                    X, w = np.frombuffer(x).reshape(-1, d), np.frombuffer(w)
                    sizes, stats = np.frombuffer(sizes, np.int64), np.frombuffer(stats).reshape(-1, 3 * d + 2)
                    for (k, r), C in bc.value.items():
                        cnt, sse, sums = _block_sums(X, w, sizes, stats, C)
                        rows += [(k, r, j, cnt[j], sse[j], *sums[j].tolist()) for j in range(len(C))]
                yield pd.DataFrame(rows, columns=["k", "run", "j", "cnt", "sse"] + [f"s{i}" for i in range(d)])

        agg = (blocks.mapInPandas(partial, schema)
               .groupBy("k", "run", "j").agg(F.sum("cnt").alias("cnt"), F.sum("sse").alias("sse"),
                                             *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)])
               .collect())  # at most runs x k rows
        bc.unpersist()
        out = {}
        for row in agg:
            out.setdefault((row["k"], row["run"]), {})[row["j"]] = row
        return out

    active = dict(runs)
    final = {}
    for _ in range(max_iter):
        if not active:
            break
        stats = one_pass(active)
        nxt = {}
        for key, C in active.items():
            new = C.copy()
            for j, row in stats.get(key, {}).items():
                if row["cnt"]:
                    new[j] = [row[f"s{i}"] / row["cnt"] for i in range(d)]
            shift = float(((new - C) ** 2).sum())
            if shift <= tol_abs:
                final[key] = new
            else:
                nxt[key] = new
        active = nxt
    final.update(active)
    # inertia of every run with its final centres (one more pass)
    stats = one_pass(final)
    rows, models = [], {}
    for k in ks:
        cost = {r: sum(row["sse"] for row in stats.get((k, r), {}).values()) for r in range(n_init) if (k, r) in final}
        best = min(cost, key=lambda r: (cost[r], r))
        models[k] = final[(k, best)]
        rows.append((k, float(cost[best])))
    blocks.unpersist()
    pts.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double"), models


def _kmeans_mllib(pts: DataFrame, cols: list[str], ks: list[int], n_init: int, seed: int,
                  max_iter: int) -> tuple[DataFrame, dict]:
    from concurrent.futures import ThreadPoolExecutor
    vec = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="features") \
        .transform(pts).select("features", "w").persist()

    def fit(args):
        k, s = args
        m = KMeans(k=k, seed=seed + s, maxIter=max_iter, initMode="k-means||", weightCol="w").fit(vec)
        return k, m.summary.trainingCost, s, m

    grid = [(k, s) for k in ks for s in range(n_init)]
    # restarts are independent Spark jobs; submit them concurrently
    with ThreadPoolExecutor(max_workers=8) as pool:
        fits = list(pool.map(fit, grid))
    models, rows = {}, []
    for k in ks:
        cost, _, m = min(((c, s, m) for kk, c, s, m in fits if kk == k), key=lambda t: (t[0], t[1]))
        import numpy as np
        models[k] = np.array([np.asarray(c, dtype=float) for c in m.clusterCenters()])
        rows.append((k, float(cost)))
    vec.unpersist()
    pts.unpersist()
    return pts.sparkSession.createDataFrame(rows, "k int, inertia double"), models


def assign(scaled: DataFrame, cols: list[str], centres, out: str = "cluster") -> DataFrame:
    """Nearest centre per row as one JVM expression (k <= 5 literal
    centres, squared distances, ties to the lower index)."""
    dist = [sum((F.pow(F.col(f"`{c}`") - F.lit(float(v)), 2) for c, v in zip(cols, ctr)), F.lit(0.0))
            for ctr in centres]
    best = F.lit(0)
    best_d = dist[0]
    for j in range(1, len(dist)):
        best = F.when(dist[j] < best_d, F.lit(j)).otherwise(best)
        best_d = F.least(best_d, dist[j])
    return scaled.withColumn(out, best)


def elbow(inertias: DataFrame) -> DataFrame:
    """K at the largest second difference of inertia (+1 index); 2 when
    fewer than 3 k values.  The input holds one row per k (<= 4 rows), so the
    ordered window runs over that tiny table only."""
    w = Window.orderBy("k")
    d = (inertias.withColumn("delta", F.col("inertia") - F.lead("inertia").over(w))
         .withColumn("second", F.col("delta") - F.lead("delta").over(w))
         .withColumn("next_k", F.lead("k").over(w)))
    best = d.where(F.col("second").isNotNull()).agg(
        F.max_by("next_k", F.struct(F.col("second"), -F.col("k"))).alias("optimal_k"))
    return best.select(F.coalesce("optimal_k", F.lit(2)).alias("optimal_k"))


def cluster_sizes(assigned: DataFrame, label: str = "cluster") -> DataFrame:
    """Cluster sizes, share in %, and the imbalance flag (min/max < .15)."""
    s = assigned.groupBy(_q(label)).agg(F.count(F.lit(1)).alias("size"))
    from tablight.operators.aggregates import attach_scalar
    tot = s.agg(F.sum("size").alias("_t"), F.min("size").alias("_mn"), F.max("size").alias("_mx"))
    return (attach_scalar(s, tot)
            .select(_q(label), "size", F.round(F.col("size") * 100.0 / F.col("_t"), 1).alias("size_pct"),
                    ((F.col("_mn") / F.col("_mx")) < 0.15).alias("imbalanced")))


def silhouette(assigned: DataFrame, cols: list[str], label: str = "cluster",
               distance: str = "squaredEuclidean") -> float:
    """MLlib's linear-time silhouette (squared Euclidean by default); the mean
    Euclidean one is ``silhouette_euclidean``."""
    vec = _vectors(assigned.withColumn("_pred", _q(label).cast("double")), cols)
    return ClusteringEvaluator(predictionCol="_pred", featuresCol="features",
                               distanceMeasure=distance).evaluate(vec)


def silhouette_band(score: Column) -> Column:
    """The reading of a mean silhouette."""
    return (F.when(score.isNull(), None).when(score >= 0.7, "Strong").when(score >= 0.5, "Good")
            .when(score >= 0.25, "Moderate").otherwise("Weak"))


#: Anchors of all clusters together, and cells a side that the search begins with.
ANCHORS, FINEST = 1024, 64


def _anchors(points: DataFrame, d: int, limit: int, finest: int) -> list:
    """Mean, weight and root mean square radius of the points of each occupied
    cell of a grid over each cluster, the finest grid with at most ``limit``
    cells."""
    x = [f"x{i}" for i in range(d)]
    ends = points.agg(*[F.min(c).alias(f"lo{c}") for c in x], *[F.max(c).alias(f"hi{c}") for c in x]).first()
    side = finest
    while True:
        cell = [F.least(F.floor((F.col(c) - F.lit(ends[f"lo{c}"])) / F.lit(max(ends[f"hi{c}"] - ends[f"lo{c}"], 1e-300)) * side),
                        F.lit(side - 1)).alias(f"g{i}") for i, c in enumerate(x)]
        radius = F.sqrt(sum((F.var_pop(c) for c in x), F.lit(0.0)))
        cells = points.groupBy("c", *cell).agg(F.count(F.lit(1)).alias("w"), radius.alias("r"), *[F.avg(c).alias(c) for c in x])
        rows = cells.select("c", "w", "r", *x).limit(limit + 1).collect()
        if len(rows) <= limit or side == 1:
            return cells.select("c", "w", "r", *x).collect() if len(rows) > limit else rows
        side //= 2


def silhouette_euclidean(assigned: DataFrame, cols: list[str], label: str = "cluster", anchors: int = ANCHORS,
                         finest: int = FINEST) -> DataFrame:
    """Mean Euclidean silhouette without pairs of points: (silhouette, low,
    high, band, warning).

    Each cluster is stood for by weighted anchors, the means of its points in
    the cells of a grid (``anchors`` in all).  A distance to a point differs
    from that to its anchor by at most the distance between the two, so the
    mean distance from any place to a cluster is off by at most the clusters'
    mean distance from their anchors, which the cells' root mean square radii
    bound.  ``low`` and ``high`` carry that bound through every point's
    silhouette, so the exact value lies between them; where every cell holds
    equal points only, both are exact.  A point alone in its cluster counts 0.
    Work: points times anchors; only the anchors go to every task.  No row
    without two clusters."""
    import numpy as np
    import pandas as pd
    d = len(cols)
    x = [f"x{i}" for i in range(d)]
    points = assigned.select(_q(label).cast("string").alias("c"), *[_q(c).cast("double").alias(n) for c, n in zip(cols, x)])
    points = points.where(F.col("c").isNotNull()).dropna()
    rows = _anchors(points, d, anchors, finest)
    names = sorted({r["c"] for r in rows})
    spark = assigned.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "silhouette double, low double, high double, band string, warning boolean")
    code = {n: i for i, n in enumerate(names)}
    rows.sort(key=lambda r: code[r["c"]])
    A = np.array([[r[c] for c in x] for r in rows], float)
    w = np.array([r["w"] for r in rows], float)
    of = np.array([code[r["c"]] for r in rows])
    size = np.bincount(of, w)
    slack = np.bincount(of, w * np.array([r["r"] or 0.0 for r in rows])) / size
    share = np.zeros((len(A), len(names)))  # what an anchor adds to each cluster's distance
    share[np.arange(len(A)), of] = w
    sent = spark.sparkContext.broadcast((A, share, size, slack, names))

    def score(a, b):
        top = np.maximum(a, b)
        return np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0)

    def work(batches):
        A, share, size, slack, names = sent.value
        B, AA = -2 * A.T, (A * A).sum(1)
        for pdf in batches:
            out = np.zeros((3, len(pdf)))
            own_all = pd.Index(names).get_indexer(pdf["c"])
            X_all = pdf[x].to_numpy(float)
            for lo in range(0, len(pdf), 256):
                X, own = X_all[lo:lo + 256], own_all[lo:lo + 256]
                sq = X @ B
                sq += (X * X).sum(1)[:, None]
                sq += AA
                np.sqrt(np.maximum(sq, 0, out=sq), out=sq)
                mean = (sq @ share) / size
                at = np.arange(len(X))
                grown = size[own] / np.maximum(size[own] - 1, 1)
                a, ea = mean[at, own] * grown, slack[own] * grown
                near, far = np.maximum(mean - slack, 0), mean + slack
                for m in (mean, near, far):
                    m[at, own] = np.inf
                alone = size[own] <= 1
                for k, s in enumerate((score(a, mean.min(1)), score(a + ea, near.min(1)),
                                       score(np.maximum(a - ea, 0), far.min(1)))):
                    out[k, lo:lo + 256] = np.where(alone, 0.0, s)
            yield pd.DataFrame({"n": [len(pdf)], "s": [out[0].sum()], "lo": [out[1].sum()], "hi": [out[2].sum()]})

    total = points.mapInPandas(work, "n long, s double, lo double, hi double").agg(*[F.sum(c).alias(c) for c in ("n", "s", "lo", "hi")])
    out = total.select((F.col("s") / F.col("n")).alias("silhouette"), (F.col("lo") / F.col("n")).alias("low"),
                       (F.col("hi") / F.col("n")).alias("high"))
    return out.withColumn("band", silhouette_band(F.col("silhouette"))).withColumn("warning", F.col("silhouette") < 0.25)


#: Centroids that are compared with each other on the driver.
MAX_CENTROIDS = 2048


def _centroids(assigned: DataFrame, cols: list[str], label: str) -> DataFrame:
    return assigned.groupBy(_q(label)).agg(*[F.avg(_q(c)).alias(f"c{i}") for i, c in enumerate(cols)])


def davies_bouldin(assigned: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Davies-Bouldin index (Euclidean) from centroids: mean over
    clusters of max_j (s_i + s_j) / d(c_i, c_j); > 2 flags high overlap."""
    cen = _centroids(assigned, cols, label)
    dist = F.sqrt(sum((F.pow(_q(c) - F.col(f"c{i}"), 2) for i, c in enumerate(cols)), F.lit(0.0)))
    s = (assigned.join(cen, label).groupBy(_q(label)).agg(F.avg(dist).alias("s")))
    parts = cen.join(s, label)
    few = parts.limit(MAX_CENTROIDS + 1).collect()
    if len(few) > MAX_CENTROIDS:
        raise ValueError(f"{label!r} has more than {MAX_CENTROIDS} clusters")
    import numpy as np
    C = np.array([[r[f"c{i}"] for i in range(len(cols))] for r in few], float).reshape(len(few), len(cols))
    spreads = np.array([r["s"] for r in few], float)
    score = None
    if len(few) > 1:
        gap = np.sqrt(((C[:, None, :] - C[None, :, :]) ** 2).sum(2))
        with np.errstate(divide="ignore", invalid="ignore"):
            worst = np.where(gap > 0, (spreads[:, None] + spreads[None, :]) / gap, np.inf)
        worst[np.arange(len(few)), np.arange(len(few))] = -np.inf
        score = float(worst.max(1).mean())
    return assigned.sparkSession.createDataFrame([(score,)], "davies_bouldin double").withColumn(
        "high_overlap", F.col("davies_bouldin") > 2)


def cluster_profile(assigned: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Per-cluster mean of every feature, 2 dp."""
    return assigned.groupBy(_q(label)).agg(*[F.round(F.avg(_q(c)), 2).alias(c) for c in cols])


def feature_ranking(assigned: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Delta of each cluster mean from the overall mean in units of
    max(IQR, sample std, 1e-9); level high (>= q3) / low (<= q1) / balanced;
    lower-is-better flag by name; ordered by |delta| per cluster."""
    spark = assigned.sparkSession
    long = assigned.select(_q(label), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ord"), _q(c).cast("double").alias("v"))
        for i, c in enumerate(cols)]))).where(F.col("v").isNotNull())
    q = quantiles(long, ["column"], "v", {"q1": .25, "q3": .75})
    g = long.groupBy("column").agg(F.avg("v").alias("center"), F.stddev_samp("v").alias("sd"))
    cm = long.groupBy(_q(label), "column", "ord").agg(F.avg("v").alias("cv"))
    lib = spark.createDataFrame([(c, any(p in _norm(c) for p in LOWER_IS_BETTER_PATTERNS)) for c in cols],
                                "column string, lower_is_better boolean")
    scale = F.greatest(F.col("q3") - F.col("q1"), F.coalesce(F.col("sd"), F.lit(0.0)), F.lit(1e-9))
    t = (cm.join(F.broadcast(q.join(g, "column")), "column").join(F.broadcast(lib), "column")
         .withColumn("delta", F.round((F.col("cv") - F.col("center")) / scale, 3))
         .withColumn("level", F.when(F.col("cv") >= F.col("q3"), "high").when(F.col("cv") <= F.col("q1"), "low")
                     .otherwise("balanced"))
         .withColumn("value", F.round("cv", 2)))
    w = Window.partitionBy(_q(label)).orderBy(F.abs("delta").desc(), "ord")
    return t.withColumn("rank", F.row_number().over(w)).select(
        _q(label), "rank", "column", "value", "level", "delta", "lower_is_better")


def top_categories(assigned: DataFrame, df_cats: list[str], label: str = "cluster", k: int = 3) -> DataFrame:
    """C11: for category-named text columns (2..min(50, max(3, .6 n))
    distinct non-blank values, first 4), the top-3 values per cluster with %."""
    fields = {f.name: f.dataType for f in assigned.schema.fields}
    cands = [c for c in df_cats if c in fields and not is_numeric_type(fields[c])
             and any(p == _norm(c) or p in _norm(c) for p in CATEGORY_CANDIDATE_PATTERNS)]
    if cands:
        from tablight.operators.relational import distinct_counts
        nd = distinct_counts(assigned, cands, blank_as_null=True)
        nn = assigned.agg(*[F.count(F.nullif(F.trim(_q(c).cast("string")), F.lit(""))).alias(f"n{i}")
                            for i, c in enumerate(cands)]).collect()[0]
        cands = [c for i, c in enumerate(cands) if 1 < nd[c] <= min(50, max(3, nn[f"n{i}"] * 0.6))][:4]
    spark = assigned.sparkSession
    if not cands:
        return spark.createDataFrame([], "cluster int, column string, value string, count long, pct double")
    long = assigned.select(_q(label), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.nullif(F.trim(_q(c).cast("string")), F.lit("")).alias("value"))
        for c in cands]))).where(F.col("value").isNotNull())
    cnt = long.groupBy(_q(label), "column", "value").agg(F.count(F.lit(1)).alias("count"))
    tot = cnt.groupBy(_q(label), "column").agg(F.sum("count").alias("_t"))
    top = top_k_per_group(cnt, [label, "column"], [F.col("count").desc(), F.col("value")], k, ["value"])
    return (top.join(tot, [label, "column"])
            .withColumn("pct", F.round(F.col("count") * 100.0 / F.col("_t"), 1)).drop("_t", "_k"))


def project(scaled: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """2-D PCA projection; each axis' sign is fixed so that its largest
    absolute loading is positive."""
    keep = keep or []
    vec = _vectors(scaled, cols)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vec)
    pcs = model.pc.toArray()
    signs = []
    for j in range(2):
        col = pcs[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(vec).withColumn("_pc", vector_to_array("pc"))
    return out.select(*[_q(k) for k in keep], (F.col("_pc")[0] * signs[0]).alias("x"),
                      (F.col("_pc")[1] * signs[1]).alias("y"))


def cluster(df: DataFrame, features: list[str] | None = None, key: str | None = None,
            max_k: int = 5, n_init: int = 10) -> dict:
    """End-to-end clustering: features, scaling, sweep, elbow, assignment and
    quality.  Returns a dict of DataFrames / numbers (one job per step)."""
    feats = features or select_features(df)
    if len(feats) < 2:
        raise ValueError("need at least 2 valid numeric features")
    keep = [key] if key else []
    other = [c for c in df.columns if c not in feats and c not in keep]
    # raw copies of the features travel along for per-cluster profiles
    raw = df.withColumns({f"{c}__raw": F.col(f"`{c}`") for c in feats})
    scaled = standardise(raw, feats, keep=keep + other + [f"{c}__raw" for c in feats])
    n = scaled.count()
    if n < 10:
        raise ValueError("need at least 10 complete rows")
    inertias, models = kmeans_sweep(scaled, feats, max_k, n_init)
    k = elbow(inertias).collect()[0]["optimal_k"]
    assigned = assign(scaled, feats, models[k])
    return {"features": feats, "inertias": inertias, "k": k, "assigned": assigned,
            "sizes": cluster_sizes(assigned), "silhouette": silhouette_euclidean(assigned, feats),
            "silhouette_sq": silhouette(assigned, feats),
            "davies_bouldin": davies_bouldin(assigned, feats)}

