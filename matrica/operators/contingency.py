"""Agreement of two labellings from their contingency table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, nij, ai, bj, n)``: one grouped count, margins from it."""
    from pyspark.sql import Window

    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("nij"))
    over = lambda *k: F.sum("nij").over(Window.partitionBy(*k))
    return c.withColumn("ai", over("a")).withColumn("bj", over("b")).withColumn("n", over(F.lit(0)))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ARI, NMI, homogeneity, completeness, V, Fowlkes-Mallows, variation of information."""
    t = table(df, a, b)
    n, nij = F.col("n").cast("double"), F.col("nij").cast("double")
    ai, bj = F.col("ai").cast("double"), F.col("bj").cast("double")
    pair = lambda x: x * (x - 1) / 2
    # Sums over margins: each cell adds its share of its row's or column's term.
    s = t.agg(
        F.max("n").cast("double").alias("n"),
        F.sum(pair(nij)).alias("sij"),
        F.sum(nij / ai * pair(ai)).alias("sa"),
        F.sum(nij / bj * pair(bj)).alias("sb"),
        F.sum(nij / n * F.log(n * nij / (ai * bj))).alias("mi"),
        (-F.sum(nij / n * F.log(ai / n))).alias("ha"),
        (-F.sum(nij / n * F.log(bj / n))).alias("hb"),
    )
    e = F.try_divide(F.col("sa") * F.col("sb"), pair(F.col("n")))
    top, low = F.col("sij") - e, (F.col("sa") + F.col("sb")) / 2 - e
    hom = F.when(F.col("ha") < 1e-15, 1.0).otherwise(F.try_divide("mi", "ha"))
    com = F.when(F.col("hb") < 1e-15, 1.0).otherwise(F.try_divide("mi", "hb"))
    half = (F.col("ha") + F.col("hb")) / 2
    v = F.when(hom + com == 0, 0.0).otherwise(F.try_divide(2 * hom * com, hom + com))
    fm = F.when(F.col("sij") == 0, 0.0).otherwise(F.try_divide(F.col("sij"), F.sqrt(F.col("sa") * F.col("sb"))))
    return s.select(
        F.when(F.abs(low) < 1e-12, 1.0).otherwise(F.try_divide(top, low)).alias("ari"),
        F.when(half < 1e-15, 1.0).otherwise(F.try_divide(F.col("mi"), half)).alias("nmi"),
        hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure"), fm.alias("fowlkes_mallows"),
        F.greatest(F.lit(0.0), F.col("ha") + F.col("hb") - 2 * F.col("mi")).alias("variation_of_information"),
    )


def adjusted_mutual_info(df: DataFrame, a: str, b: str) -> float:
    """AMI; the expectation runs over pairs of distinct margin values, each once."""
    t = table(df, a, b).cache()
    head = agreement(df, a, b).first()
    rows, cols = t.groupBy("a").agg(F.max("ai").alias("m")).groupBy("m").count().collect(), t.groupBy("b").agg(F.max("bj").alias("m")).groupBy("m").count().collect()
    n = t.agg(F.max("n")).first()[0]
    t.unpersist()
    if not n:
        return 1.0
    lg = math.lgamma
    emi = 0.0
    for x, cx in ((r["m"], r["count"]) for r in rows):
        for y, cy in ((r["m"], r["count"]) for r in cols):
            base = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1)
            part = 0.0
            for m in range(max(1, x + y - n), min(x, y) + 1):
                part += m / n * math.log(n * m / (x * y)) * math.exp(base - lg(m + 1) - lg(x - m + 1) - lg(y - m + 1) - lg(n - x - y + m + 1))
            emi += cx * cy * part
    hx = -sum(r["count"] * r["m"] / n * math.log(r["m"] / n) for r in rows)
    hy = -sum(r["count"] * r["m"] / n * math.log(r["m"] / n) for r in cols)
    mi = head["nmi"] * (hx + hy) / 2
    low = (hx + hy) / 2 - emi
    return 1.0 if abs(low) < 1e-15 else (mi - emi) / low
