"""Bootstrap, permutation and stability statistics with a hash generator.

Draws come from md5 of (seed, replicate, row), so any SQL engine can repeat
them.  Replicates are exploded per row and aggregated with map-side combining;
``(value, truth, ...)`` rows need a dense index ``i`` from 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.ranks import hash_int


def indexed(df: DataFrame, key: str) -> DataFrame:
    """Adds ``i`` from 0 by ``key``."""
    return df.withColumn("i", F.row_number().over(Window.orderBy(key)) - 1)


def resample_means(values: DataFrame, b: int, seed: int = 42) -> DataFrame:
    """``(b, mean)`` of bootstrap replicates of ``(i, value)``."""
    n = values.count()
    draws = values.select("i").join(values.sparkSession.range(b).select(F.col("id").alias("b"))).select("b", (hash_int(seed, F.col("b"), F.col("i")) % n).alias("i"))
    return draws.join(values, "i").groupBy("b").agg(F.avg("value").alias("mean"))


def bootstrap_mean_ci(values: DataFrame, b: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``(mean, ci_low, ci_high)``: percentile interval."""
    m = resample_means(values, b, seed)
    ends = m.agg(F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return values.agg(F.avg("value").alias("mean")).join(ends).select("mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def bca_mean_ci(values: DataFrame, b: int = 2000, alpha: float = 0.05, seed: int = 42) -> dict:
    """BCa interval of a mean; leave-one-out means in closed form."""
    from matrica.functions.tails import norm_ppf, norm_sf

    m = resample_means(values, b, seed).cache()
    head = values.agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).first()
    share = m.agg(F.avg((F.col("mean") < head["m"]).cast("double"))).first()[0]
    qs = [alpha / 2, 1 - alpha / 2]
    if 0 < share < 1 and head["n"] > 1:
        z0 = norm_ppf(share)
        d = (F.lit(head["m"]) - F.col("value")) / (head["n"] - 1) * -1.0  # mean of the leave-one-out means minus each
        s = values.agg(F.sum(F.pow(d, F.lit(3.0))).alias("c"), F.sum(d * d).alias("q")).first()
        a = s["c"] / (6 * s["q"] ** 1.5) if s["q"] else 0.0
        qs = [1 - float(norm_sf(z0 + (z0 + norm_ppf(q)) / (1 - a * (z0 + norm_ppf(q))))) for q in qs]
    lo, hi = m.agg(F.percentile("mean", F.array(*[F.lit(q) for q in qs]))).first()[0]
    m.unpersist()
    return {"mean": head["m"], "ci_low": lo, "ci_high": hi}


def permutation_pvalue(rows: DataFrame, b: int = 1000, seed: int = 42) -> DataFrame:
    """``(diff, p_value)`` of two methods' correctness ``(i, a, b)`` (0/1): rows swap by a hash bit."""
    d = rows.select("i", (F.col("a") - F.col("b")).cast("double").alias("d"))
    n = d.count()
    obs = d.agg((F.sum("d") / n).alias("diff"))
    reps = rows.sparkSession.range(b).select(F.col("id").alias("b"))
    flip = F.when(hash_int(seed, F.col("b"), F.col("i")) % 2 == 0, 1.0).otherwise(-1.0)
    # Rows on which the two agree add nothing to any replicate.
    s = d.where("d <> 0").join(reps).groupBy("b").agg((F.sum(F.col("d") * flip) / n).alias("v"))
    hit = reps.join(s, "b", "left").join(obs).agg(F.max("diff").alias("diff"), F.sum((F.abs(F.coalesce("v", F.lit(0.0))) >= F.abs("diff") - 1e-12).cast("long")).alias("c"))
    return hit.select("diff", ((F.col("c") + 1) / (b + 1)).alias("p_value"))


def paired_bootstrap(rows: DataFrame, b: int = 2000, seed: int = 42) -> DataFrame:
    """``(diff, ci_low, ci_high, p_value)`` of two methods' correctness ``(i, a, b)``."""
    v = rows.select("i", (F.col("a") - F.col("b")).cast("double").alias("value"))
    obs = v.agg(F.avg("value").alias("diff"))
    m = resample_means(v, b, seed)
    m = m.withColumn("c", F.avg("mean").over(Window.partitionBy(F.lit(0)))).join(obs)
    return m.agg(F.max("diff").alias("diff"), F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"), F.avg((F.abs(F.col("mean") - F.col("c")) >= F.abs("diff") - 1e-12).cast("double")).alias("p_value"))


def no_information_rate(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    return c.agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c").cast("double"), F.lit(2.0))).alias("rate"))


def dot632plus(train: float, oob: float, gamma: float) -> float:
    """One replicate's .632+ score (higher is better)."""
    r = min(1.0, max(0.0, (oob - train) / (gamma - train + 1e-10)))
    w = min(1.0, max(0.632, 0.632 / (1 - 0.368 * r)))
    return (1 - w) * train + w * oob


def jackknife_after_bootstrap(values: DataFrame, b: int = 2000, seed: int = 42) -> DataFrame:
    """``(i, influence, flagged)``: the mean of all replicates against those without the row.

    Replicates without row i are all less those with it, so no anti join is made.
    """
    n = values.count()
    reps = values.sparkSession.range(b).select(F.col("id").alias("b"))
    draws = values.select("i").join(reps).select("b", (hash_int(seed, F.col("b"), F.col("i")) % n).alias("i")).join(values, "i")
    m = draws.groupBy("b").agg(F.avg("value").alias("m"))
    has = draws.select("b", "i").distinct().join(m, "b").groupBy("i").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("k"))
    tot = m.agg(F.sum("m").alias("all_s"), F.count(F.lit(1)).alias("all_n"))
    j = values.select("i").join(has, "i", "left").na.fill(0).join(tot)
    left = F.col("all_n") - F.col("k")
    inf = F.when(left < 10, 0.0).otherwise(F.abs(F.col("all_s") / F.col("all_n") - F.try_divide(F.col("all_s") - F.col("s"), left)))
    j = j.select("i", inf.alias("influence"))
    q = j.agg(F.percentile("influence", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return j.join(q).select("i", "influence", (F.col("influence") > F.col("q")[1] + 2 * (F.col("q")[1] - F.col("q")[0])).alias("flagged"))


def icc(values: DataFrame) -> DataFrame:
    """ICC(1,1) of ``(target, value)`` with equal group sizes, clipped to [0, 1]; identical values give 1."""
    g = values.groupBy("target").agg(F.count(F.lit(1)).alias("k"), F.avg("value").alias("m"), F.sum(F.col("value") * F.col("value")).alias("q"))
    w = F.col("q") - F.col("k") * F.col("m") * F.col("m")
    s = g.agg(F.count(F.lit(1)).alias("t"), F.avg("k").alias("k"), F.var_samp("m").alias("vm"), F.sum(w).alias("w"), F.sum("k").alias("n"))
    msb, msw = F.col("k") * F.col("vm"), F.try_divide(F.col("w"), F.col("n") - F.col("t"))
    raw = F.try_divide(msb - msw, msb + (F.col("k") - 1) * msw)
    same = values.agg((F.max("value") == F.min("value")).alias("same"))
    return s.join(same).select(F.when(F.col("same"), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).alias("icc"))


def seed_stability(method: Callable[[int], float], n_seeds: int = 10, base_seed: int = 0) -> dict:
    """A metric per seed, its mean, deviation and 1 - cv."""
    v = [method(base_seed + k) for k in range(n_seeds)]
    m = sum(v) / len(v)
    sd = math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else 0.0
    return {"values": v, "mean": m, "std": sd, "stability": 1 - sd / abs(m) if m else float("nan")}


def time_budget(estimates: DataFrame, max_seconds: float) -> DataFrame:
    """Fastest first, with the running total and whether it still fits."""
    run = F.sum("seconds").over(Window.orderBy("seconds", "method").rowsBetween(Window.unboundedPreceding, 0))
    return estimates.withColumn("running", run).withColumn("fits", F.col("running") <= max_seconds)


COMPLEXITY: dict[str, Callable[[float, float, float], float]] = {
    "nkd": lambda n, d, k: n * k * d,
    "ndlogn": lambda n, d, k: n * d * math.log2(max(n, 2)),
    "n2d": lambda n, d, k: n * n * d,
    "n3": lambda n, d, k: n**3,
    "n2k": lambda n, d, k: n * n * k,
    "nd": lambda n, d, k: n * d,
    "nd2": lambda n, d, k: n * d * d,
}


def extrapolate(seconds: float, cost: str, n_small: int, n_full: int, d: int, k: int, grid: int = 1) -> float:
    base = COMPLEXITY[cost](n_small, d, k)
    return seconds * COMPLEXITY[cost](n_full, d, k) / base * grid if base > 0 else float("nan")
