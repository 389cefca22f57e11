"""Methods against each other: pairs, reports, sweeps and resolutions.

Pairwise tests read only the counts of agreeing and disagreeing cells: for a
difference of correctness, redrawing cells with replacement is a multinomial
draw over those counts, and flipping signs a binomial one, so the cost after
one grouped pass does not depend on the number of cells.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.tails import binom_two_sided, chi2_sf
from matrica.operators.contingency import table


def method_pairs(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``(a, b, n, only_a, only_b, diff)`` for every two methods of ``(cell_id, method, pred)``; the cells both have count.

    Methods are few, cells many: each cell's verdicts become one array, and pairs are made inside it.
    """
    ok = predictions.join(truth.select("cell_id", "true"), "cell_id").select("cell_id", "method", (F.col("pred") == F.col("true")).cast("int").alias("ok"))
    per = ok.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("method", "ok"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y["method"] > x["method"]), lambda y: F.struct(x["method"].alias("a"), y["method"].alias("b"), x["ok"].alias("oa"), y["ok"].alias("ob")))))
    p = per.select(F.explode(pairs).alias("p")).select("p.*")
    one = lambda c: F.sum(c.cast("bigint"))
    g = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), one(F.col("oa") > F.col("ob")).alias("only_a"), one(F.col("oa") < F.col("ob")).alias("only_b"))
    return g.withColumn("diff", (F.col("only_a") - F.col("only_b")) / F.col("n"))


def compare_classifiers(predictions: DataFrame, truth: DataFrame, test: str = "paired_bootstrap", b: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``(a, b, diff, ci_low, ci_high, p_value, test)``; tests are ``paired_bootstrap``, ``permutation`` (exact) and ``mcnemar``."""
    if test not in ("paired_bootstrap", "permutation", "mcnemar"):
        raise ValueError(f"unknown test: {test}")
    rng, rows = np.random.default_rng(seed), []
    for r in method_pairs(predictions, truth).orderBy("a", "b").collect():
        n, x, y = r["n"], r["only_a"], r["only_b"]
        low = high = None
        if test == "paired_bootstrap":
            draw = rng.multinomial(n, [x / n, y / n, (n - x - y) / n], size=b)
            m = (draw[:, 0] - draw[:, 1]) / n
            low, high = (float(v) for v in np.quantile(m, [alpha / 2, 1 - alpha / 2]))
            p = float(np.mean(np.abs(m - m.mean()) >= abs(r["diff"]) - 1e-12))
        elif test == "permutation" or x + y < 25:
            p = 1.0 if x + y == 0 else float(binom_two_sided(x, x + y))
        else:
            p = float(chi2_sf((abs(x - y) - 1) ** 2 / (x + y), 1))
        rows.append((r["a"], r["b"], r["diff"], low, high, p, test))
    return truth.sparkSession.createDataFrame(rows, "a string, b string, diff double, ci_low double, ci_high double, p_value double, test string")


def report(stages: dict[str, DataFrame], method: str = "method") -> DataFrame:
    """One table of all stages' results; a metric a stage lacks is null there."""
    out = None
    for name, df in stages.items():
        part = df.withColumnRenamed(method, "method").select(F.lit(name).alias("stage"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no stage to report")
    return out


def leaderboard(results: DataFrame, metric: str | None = None) -> DataFrame:
    """Rows by the first metric (the first numeric column unless named), best first, within each stage."""
    number = [c for c, k in results.dtypes if k in ("double", "float", "int", "bigint")]
    if metric is None and not number:
        raise KeyError("no numeric column to rank by")
    w = Window.partitionBy("stage") if "stage" in results.columns else Window.partitionBy(F.lit(0))
    return results.withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last(metric or number[0]), "method")))


def profile(run: Callable[[], object]) -> dict:
    """Wall time of a call and the driver's peak of Python memory; a DataFrame result is computed, not collected."""
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    try:
        got = run()
        if isinstance(got, DataFrame):
            got.write.format("noop").mode("overwrite").save()
        return {"seconds": time.perf_counter() - began, "peak_mb": tracemalloc.get_traced_memory()[1] / 2**20, "result": got}
    finally:
        tracemalloc.stop()


def subsample(df: DataFrame, n: int, key: str = "cell_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the first in hash order: the same rows in any engine."""
    from matrica.functions.ranks import hash_int

    return df.orderBy(hash_int(seed, F.col(key)), key).limit(n)


def scalability(method: Callable[[DataFrame], object], points: DataFrame, fractions: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0), n_seeds: int = 1, seed: int = 42) -> DataFrame:
    """``(fraction, n, seed, seconds, peak_mb, status)`` on growing subsamples of at least two cells; failures keep a row."""
    n, rows = points.count(), []
    for f in fractions:
        if not 0 < f <= 1:
            raise ValueError(f"fraction {f} is not in (0, 1]")
        take = min(n, max(2, math.ceil(n * f)))
        for s in range(n_seeds):
            try:
                got = profile(lambda: method(subsample(points, take, seed=seed + s)))
                rows.append((float(f), take, seed + s, got["seconds"], got["peak_mb"], "ok"))
            except MemoryError:
                raise
            except Exception as e:  # the row stays, with its reason
                rows.append((float(f), take, seed + s, None, None, f"{type(e).__name__}: {e}"[:300]))
    return points.sparkSession.createDataFrame(rows, "fraction double, n bigint, seed int, seconds double, peak_mb double, status string")


def format_time(seconds: float) -> str:
    if seconds is None or math.isnan(seconds):
        return "unavailable"
    if seconds < 1:
        return f"{seconds * 1000:.0f} ms"
    if seconds < 60:
        return f"{seconds:.1f} s"
    return f"{seconds / 60:.1f} min" if seconds < 3600 else f"{seconds / 3600:.1f} h"


def nvi(assignments: DataFrame) -> DataFrame:
    """``(resolution, next_resolution, vi, nvi)`` of ``(resolution, cell_id, cluster)``: variation of information of neighbouring resolutions over ln n."""
    steps = assignments.select("resolution").distinct().withColumn("next_resolution", F.lead("resolution").over(Window.orderBy("resolution"))).where("next_resolution is not null")
    a = assignments.select("resolution", "cell_id", F.col("cluster").alias("ca")).join(F.broadcast(steps), "resolution")
    b = assignments.select(F.col("resolution").alias("next_resolution"), "cell_id", F.col("cluster").alias("cb"))
    c = a.join(b, ["next_resolution", "cell_id"]).groupBy("resolution", "next_resolution", "ca", "cb").agg(F.count(F.lit(1)).cast("double").alias("k"))
    over = lambda *x: F.sum("k").over(Window.partitionBy("resolution", *x))
    c = c.withColumn("n", over()).withColumn("ka", over("ca")).withColumn("kb", over("cb"))
    vi = F.sum(F.col("k") / F.col("n") * (F.log(F.col("ka") / F.col("k")) + F.log(F.col("kb") / F.col("k"))))
    g = c.groupBy("resolution", "next_resolution").agg(F.greatest(F.lit(0.0), vi).alias("vi"), F.max("n").alias("n"))
    return g.select("resolution", "next_resolution", "vi", F.when(F.col("n") > 1, F.col("vi") / F.log("n")).otherwise(0.0).alias("nvi"))


def stable_resolution(assignments: DataFrame) -> float:
    """The lower resolution of the pair that differs least; ties to the smallest."""
    r = nvi(assignments).orderBy("nvi", "resolution").first()
    if r is None:
        raise ValueError("two resolutions at least")
    return float(r["resolution"])


def search_resolution(score: Callable[[float], float], grid: list[float], refine: int = 5) -> tuple[float, list[tuple[float, float]]]:
    """The best of a coarse grid, then the two midpoints beside the best, ``refine`` times; all tries come back too."""
    if not grid:
        raise ValueError("an empty grid")
    tried = {float(r): score(float(r)) for r in grid}
    for _ in range(refine):
        at = sorted(tried)
        i = max(range(len(at)), key=lambda j: (tried[at[j]], -j))
        for j in (i - 1, i + 1):
            if 0 <= j < len(at):
                mid = (at[i] + at[j]) / 2
                if mid not in tried:
                    tried[mid] = score(mid)
    best = max(sorted(tried), key=lambda r: tried[r])
    return best, sorted(tried.items())


def bootstrap_agreement(df: DataFrame, true: str, pred: str, b: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``(metric, value, ci_low, ci_high)`` of ARI and NMI over redrawn cells with fixed labels.

    Redrawing cells is a multinomial draw of the contingency table, which is
    all that leaves Spark; its size (labels by clusters) is checked.
    """
    rows = table(df, true, pred).select("a", "b", "nij").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("contingency table of over a million cells")
    ia, ib = (np.unique([str(r[c]) for r in rows], return_inverse=True)[1] for c in ("a", "b"))
    k = np.array([r["nij"] for r in rows], float)
    n = int(k.sum())
    rng = np.random.default_rng(seed)

    def both(w: np.ndarray) -> tuple[float, float]:
        ai, bj = np.bincount(ia, w), np.bincount(ib, w)
        pair = lambda x: (x * (x - 1) / 2).sum()
        e, half = pair(ai) * pair(bj) / max(n * (n - 1) / 2, 1), (pair(ai) + pair(bj)) / 2
        q = lambda x: x[x > 0] / n
        ha, hb = (-(q(x) * np.log(q(x))).sum() for x in (ai, bj))
        mi = ha + hb + (q(w) * np.log(q(w))).sum()
        return (1.0 if abs(half - e) < 1e-12 else (pair(w) - e) / (half - e)), (1.0 if ha + hb < 2e-15 else 2 * mi / (ha + hb))

    point = both(k)
    draws = np.array([both(rng.multinomial(n, k / n).astype(float)) for _ in range(b)])
    low, high = np.quantile(draws, [alpha / 2, 1 - alpha / 2], axis=0)
    out = [(m, float(point[i]), float(low[i]), float(high[i])) for i, m in enumerate(("ari", "nmi"))]
    return df.sparkSession.createDataFrame(out, "metric string, value double, ci_low double, ci_high double")
