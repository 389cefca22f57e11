"""Checks of a matrix before models are chosen: normality per gene and equality of covariances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.frame import CellFrame
from matrica.functions.normality import anderson, shapiro
from matrica.functions.ranks import hash_int
from matrica.functions.tails import chi2_sf

#: Features whose covariance matrices may be compared on the driver.
MAX_FEATURES = 500


def normality_per_gene(frame: CellFrame, sample_size: int = 500, seed: int = 42, layer: str | None = None) -> DataFrame:
    """``(gene_id, w, p_value, a2, critical)`` over at most ``sample_size`` cells, the least by hash; zeros count."""
    some = frame.obs.select("cell_id").orderBy(hash_int(seed, F.lit(0), F.col("cell_id")), "cell_id").limit(sample_size)
    n = some.count()
    lists = frame.matrix(layer).join(F.broadcast(some), "cell_id").groupBy("gene_id").agg(F.collect_list("value").alias("v"))
    every = frame.var.select("gene_id").join(lists, "gene_id", "left").select("gene_id", F.coalesce("v", F.array().cast("array<double>")).alias("v"))
    kind = dict(frame.var.dtypes)["gene_id"]

    def run(parts):
        for p in parts:
            rows = []
            for gene, v in zip(p["gene_id"], p["v"]):
                x = np.zeros(n)
                x[: len(v)] = v
                rows.append((gene, *shapiro(x), *anderson(x)))
            yield pd.DataFrame(rows, columns=["gene_id", "w", "p_value", "a2", "critical"])

    return every.mapInPandas(run, f"gene_id {kind}, w double, p_value double, a2 double, critical double")


def check_normality(frame: CellFrame, alpha: float = 0.05, sample_size: int = 500, threshold: float = 0.3, correction: str | None = None, seed: int = 42, layer: str | None = None) -> DataFrame:
    """``(n_genes, shapiro_pass, anderson_pass, is_normal)``: shares of all genes that pass; genes without a statistic fail.

    With ``correction="bh"`` the matrix is normal if under half of the genes
    are rejected after adjustment, else if both shares are above ``threshold``.
    """
    from matrica.functions.ranks import adjust_pvalues

    t = normality_per_gene(frame, sample_size, seed, layer)
    t = t.withColumn("p_value", F.when(F.isnan("p_value"), F.lit(0.0)).otherwise(F.col("p_value")))
    t = adjust_pvalues(t, "p_value", "fdr_bh", tie="gene_id")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    s = t.agg(F.count(F.lit(1)).alias("n_genes"), share(F.col("p_value") > alpha).alias("shapiro_pass"), share((F.col("a2") < F.col("critical")) & ~F.isnan("a2")).alias("anderson_pass"), share(F.col("p_adjusted") <= alpha).alias("_r"))
    ok = F.col("_r") < 0.5 if correction == "bh" else (F.col("shapiro_pass") > threshold) & (F.col("anderson_pass") > threshold)
    return s.select("n_genes", "shapiro_pass", "anderson_pass", ok.alias("is_normal"))


def covariances(points: DataFrame) -> dict[str, tuple[int, np.ndarray]]:
    """Size and covariance matrix of each group of ``(cell_id, vec, grp)``, from sums of products in Spark."""
    p = points.select(F.size("vec").alias("p")).limit(1).collect()
    p = p[0]["p"] if p else 0
    if p > MAX_FEATURES:
        raise ValueError(f"{p} features; at most {MAX_FEATURES}")

    def run(parts):
        held: dict[str, list] = {}
        for b in parts:
            for grp, sub in b.groupby("grp"):
                x = np.array(sub["vec"].tolist(), float)
                h = held.setdefault(grp, [0, np.zeros(p), np.zeros((p, p))])
                h[0], h[1], h[2] = h[0] + len(x), h[1] + x.sum(0), h[2] + x.T @ x
        yield pd.DataFrame([(g, n, s.tobytes(), q.tobytes()) for g, (n, s, q) in held.items()], columns=["grp", "n", "s", "q"])

    out: dict[str, list] = {}
    for r in points.where("grp is not null").select(F.col("grp").cast("string").alias("grp"), "vec").mapInPandas(run, "grp string, n long, s binary, q binary").toLocalIterator():
        h = out.setdefault(r["grp"], [0, np.zeros(p), np.zeros((p, p))])
        h[0], h[1], h[2] = h[0] + r["n"], h[1] + np.frombuffer(r["s"]), h[2] + np.frombuffer(r["q"]).reshape(p, p)
    return {g: (n, (q - np.outer(s, s) / n) / max(n - 1, 1)) for g, (n, s, q) in out.items()}


def box_m(points: DataFrame) -> dict:
    """Box's M of equal covariances with its chi-square form and the discriminant it speaks for.

    Groups under two rows are left out; if a group has no more rows than
    features, or a matrix is singular, nothing is tested and QDA is named.
    """
    groups = {g: v for g, v in covariances(points).items() if v[0] >= 2}
    none = {"m": math.nan, "chi2": math.nan, "df": 0, "p_value": math.nan, "recommendation": "QDA"}
    if len(groups) < 2:
        return none
    sizes = np.array([n for n, _ in groups.values()], float)
    cov = [c for _, c in groups.values()]
    p, k, n = len(cov[0]), len(cov), sizes.sum()
    if p >= sizes.min():
        return none
    pooled = sum((s - 1) * c for s, c in zip(sizes, cov)) / (n - k)
    signs, logs = zip(*(np.linalg.slogdet(c) for c in [pooled, *cov]))
    if min(signs) <= 0 or not np.isfinite(logs).all():
        return none
    m = (n - k) * logs[0] - float(((sizes - 1) * np.array(logs[1:])).sum())
    c1 = ((1 / (sizes - 1)).sum() - 1 / (n - k)) * (2 * p * p + 3 * p - 1) / (6 * (p + 1) * (k - 1))
    if c1 >= 1:
        return none
    df = p * (p + 1) * (k - 1) // 2
    tail = float(chi2_sf(m * (1 - c1), df))
    return {"m": float(m), "chi2": float(m * (1 - c1)), "df": df, "p_value": tail, "recommendation": "LDA" if tail > 0.05 else "QDA"}


def influence_flags(scores: DataFrame, score_col: str = "influence") -> DataFrame:
    """Adds ``influential``: further from the median than twice the interquartile range."""
    w = Window.partitionBy(F.lit(0))
    q = lambda p: F.percentile(score_col, p).over(w)
    return scores.withColumn("influential", F.abs(F.col(score_col) - q(0.5)) > 2 * (q(0.75) - q(0.25)))
