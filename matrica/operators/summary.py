"""Summaries, group means, pseudobulk, majority votes and gene filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.frame import CellFrame


def sparsity(frame: CellFrame, layer: str | None = None) -> float:
    n = frame.n_cells() * frame.n_genes()
    return 1 - frame.matrix(layer).where("value <> 0").count() / n if n else 0.0


def dataset_summary(frame: CellFrame, layer: str | None = None) -> DataFrame:
    """One row: cells, genes, total, mean total per cell, share of zeros."""
    n, p = frame.n_cells(), frame.n_genes()
    got = frame.matrix(layer).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.sum((F.col("value") != 0).cast("long")).alias("nnz"))
    return got.select(F.lit(n).cast("long").alias("n_cells"), F.lit(p).cast("long").alias("n_genes"), "total", (F.col("total") / max(n, 1)).alias("mean_per_cell"), (1 - F.coalesce("nnz", F.lit(0)) / max(n * p, 1)).alias("sparsity"))


def expressed_genes(frame: CellFrame, min_cells: int = 1, layer: str | None = None) -> DataFrame:
    """``(gene_id, n_cells)`` of genes above 0 in at least ``min_cells`` cells."""
    c = frame.matrix(layer).where("value > 0").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_cells"))
    all_ = frame.var.select("gene_id", "gene_ord").join(c, "gene_id", "left").select("gene_id", "gene_ord", F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))
    return (all_ if min_cells <= 0 else all_.where(F.col("n_cells") >= min_cells)).select("gene_id", "n_cells")


def sample_counts(frame: CellFrame, group_col: str) -> DataFrame:
    frame.require_obs(group_col)
    return frame.obs.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group_col)


def mean_by_group(frame: CellFrame, group_col: str, genes: list | None = None, layer: str | None = None) -> DataFrame:
    """Group by gene means over all cells of the group, zeros included; an empty list means all genes."""
    frame.require_obs(group_col)
    var = frame.var.select("gene_id")
    if genes:
        var = var.where(F.col("gene_id").isin(genes))
    obs = frame.obs.where(F.col(group_col).isNotNull()).select("cell_id", F.col(group_col).alias("group"))
    size = obs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    s = frame.matrix(layer).join(F.broadcast(var), "gene_id", "left_semi").join(obs, "cell_id").groupBy("group", "gene_id").agg(F.sum("value").alias("s"))
    # Every (group, gene): groups and genes are the result's own rows and columns.
    grid = size.join(var)
    return grid.join(s, ["group", "gene_id"], "left").select("group", "gene_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))


def pseudobulk(frame: CellFrame, sample_col: str, type_col: str, method: str = "median", layer: str | None = None) -> DataFrame:
    """(sample, type) by gene medians or means, absent values counted as 0.

    The median needs no dense grid: absent cells are zeros at one place of the
    sorted values, so it is read off the sorted non-zeros of each group.
    """
    frame.require_obs(sample_col, type_col)
    obs = frame.obs.select("cell_id", F.col(sample_col).alias("sample"), F.col(type_col).alias("type")).dropna()
    size = obs.groupBy("sample", "type").agg(F.count(F.lit(1)).alias("n"))
    v = frame.matrix(layer).join(obs, "cell_id")
    if method == "median":
        g = v.groupBy("sample", "type", "gene_id").agg(F.sort_array(F.collect_list("value")).alias("v")).join(size, ["sample", "type"])
        neg = F.size(F.filter("v", lambda x: x < 0))
        pick = lambda i: F.when(i < neg, F.get("v", i)).when(i < neg + F.col("n") - F.size("v"), 0.0).otherwise(F.get("v", (i - (F.col("n") - F.size("v"))).cast("int")))
        lo, hi = F.floor((F.col("n") - 1) / 2).cast("int"), F.floor(F.col("n") / 2).cast("int")
        s = g.select("sample", "type", "gene_id", ((pick(lo) + pick(hi)) / 2).alias("value"))
    else:
        s = v.groupBy("sample", "type", "gene_id").agg(F.sum("value").alias("s")).join(size, ["sample", "type"]).select("sample", "type", "gene_id", (F.col("s") / F.col("n")).alias("value"))
    grid = size.select("sample", "type").join(frame.var.select("gene_id"))
    return grid.join(s, ["sample", "type", "gene_id"], "left").select("sample", "type", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    c = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), F.col(value)))
    return c.withColumn("r", r).where("r = 1").select(key, value)


def patient_majority(df: DataFrame, patient: str, true: str, pred: str) -> DataFrame:
    """Majority label and prediction per patient."""
    return _mode(df, patient, true).join(_mode(df, patient, pred), patient)


def confusion_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def map_clusters(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``(cluster, label)``: majority label, ties to the smallest."""
    return _mode(df, cluster, label)


def mapped_accuracy(df: DataFrame, cluster: str, label: str, noise: str | None = "-1") -> DataFrame:
    """Share of all rows whose cluster's majority label is theirs; noise counts as wrong."""
    inner = df if noise is None else df.where(F.col(cluster).cast("string") != noise)
    m = map_clusters(inner, cluster, label).withColumnRenamed(label, "_m")
    return df.join(m, cluster, "left").agg(F.avg(F.coalesce((F.col(label) == F.col("_m")).cast("double"), F.lit(0.0))).alias("accuracy"))


def filter_de(de: DataFrame, log2fc: float = 1.0, alpha: float = 0.05, effect_col: str | None = None, effect: float = 0.3) -> DataFrame:
    out = de.where((F.col("p_adjusted") < alpha) & (F.abs("log2fc") >= log2fc))
    return out.where(F.abs(F.col(effect_col)) >= effect) if effect_col else out


def volcano(de: DataFrame, log2fc: float = 1.0, alpha: float = 0.05) -> DataFrame:
    sig = (F.col("p_adjusted") < alpha) & (F.abs("log2fc") >= log2fc)
    return de.withColumn("significant", sig).withColumn("regulation", F.when(sig & (F.col("log2fc") > 0), "up").when(sig, "down").otherwise("not_significant")).withColumn("neg_log10_p", -F.log10(F.col("p_adjusted") + 1e-300))


def label_confusion(pred: DataFrame, min_count: int = 0, normalise: bool = True) -> DataFrame:
    """``(true, pred, n, share)`` over all models' predictions ``(cell_type, pred)``, the diagonal left out."""
    c = pred.where(F.col("cell_type") != F.col("pred")).groupBy(F.col("cell_type").alias("true"), "pred").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true"))) if normalise else c


def confusion_edges(pred: DataFrame, min_confusion: int = 1) -> DataFrame:
    """Undirected weights: confusions in both directions together."""
    e = pred.where(F.col("cell_type") != F.col("pred")).groupBy(F.least("cell_type", "pred").alias("a"), F.greatest("cell_type", "pred").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return e.where(F.col("weight") >= min_confusion)
