"""The tables behind the figures: what is drawn, aggregated in Spark, without a drawing library.

Tables of points (embeddings) keep one row per cell; all others are as small
as the figure they feed.  Implicit zeros are counted, never materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.frame import CellFrame


def benchmark_bars(results: DataFrame, metrics: tuple[str, ...] = ("ari", "ami"), method: str = "method") -> DataFrame:
    """``(position, method, metrics...)``, best first by the first metric, nulls last, ties by name."""
    have = [m for m in metrics if m in results.columns]
    if not have:
        raise KeyError(f"none of {list(metrics)} in {results.columns}")
    order = Window.orderBy(F.desc_nulls_last(have[0]), method)
    return results.select(F.row_number().over(order).alias("position"), method, *have)


def model_by_space(results: DataFrame, metric: str = "accuracy", spaces: list[str] | None = None) -> DataFrame:
    """``(model, <space>_mean, <space>_sd, <space>_se)`` of rows ``(model, space, metric)``."""
    n = F.count(metric)
    return results.groupBy("model").pivot("space", spaces).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.try_divide(F.stddev_samp(metric), F.sqrt(n)).alias("se"))


def metric_rows(results: DataFrame, metrics: list[str] | None = None, method: str = "method") -> DataFrame:
    """``(method, metric, value)``: radar, comparison and heat map read this; default metrics are all numeric columns."""
    number = ("double", "float", "int", "bigint", "smallint", "tinyint")
    metrics = metrics or [c for c, k in results.dtypes if c != method and k in number]
    missing = [m for m in metrics if m not in results.columns]
    if missing or not metrics:
        raise KeyError(f"no metric columns {missing}; have {results.columns}")
    return results.select(method, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(method, metrics, "metric", "value")


def flows(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``(cluster, label, n)``: non-zero flows of a Sankey diagram."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def metric_correlation(means: DataFrame, x: str, y: str) -> DataFrame:
    """One row over label means: Pearson, Spearman (midranks) and the least-squares line; rows with a null are left out."""
    from matrica.functions.ranks import midrank

    d = means.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = d.withColumn("rx", midrank("x")).withColumn("ry", midrank("y"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def ma_table(de: DataFrame, mean_col: str | None = None, gene: str = "gene_id") -> DataFrame:
    """``(gene, mean, log2fc)``; without a mean the position in gene order stands in for it."""
    mean = F.col(mean_col) if mean_col else (F.row_number().over(Window.orderBy(gene)) - 1).cast("double")
    return de.select(gene, mean.alias("mean"), "log2fc")


def scatter(points: DataFrame, obs: DataFrame, colour: str | None, dims: int = 2) -> DataFrame:
    """``(cell_id, c1.., colour)``: the first coordinates of each cell; a missing coordinate is an error, not a null."""
    at = [F.element_at("vec", i + 1).alias(f"c{i + 1}") for i in range(dims)]
    ok = points.where(F.assert_true(F.size("vec") >= dims, F.lit(f"fewer than {dims} coordinates")).isNull())
    out = ok.select("cell_id", *at)
    return out.join(obs.select("cell_id", F.col(colour).alias("colour")), "cell_id", "left") if colour else out


def compare_bases(frame: CellFrame, bases: list[str], colour: str, dims: int = 2) -> DataFrame:
    """``scatter`` of several embeddings, told apart by ``basis``."""
    frame.require_obs(colour)
    missing = [b for b in bases if b not in frame.obsm]
    if missing or not bases:
        raise KeyError(f"no embedding {missing}; have {sorted(frame.obsm)}")
    out = None
    for b in bases:
        part = scatter(frame.obsm[b], frame.obs, colour, dims).withColumn("basis", F.lit(b))
        out = part if out is None else out.unionByName(part)
    return out


def before_after(before: CellFrame, after: CellFrame, basis_before: str, basis_after: str, colour: str) -> DataFrame:
    """Coordinates of both states of a batch correction, told apart by ``state``."""
    a = scatter(before.obsm[basis_before], before.obs, colour).withColumn("state", F.lit("before"))
    return a.unionByName(scatter(after.obsm[basis_after], after.obs, colour).withColumn("state", F.lit("after")))


def _with_zeros(x: DataFrame, keys: list[str], sizes: DataFrame, genes: DataFrame) -> DataFrame:
    """Values counted by key, and one weighted row for the zeros of each key; ``genes`` and ``sizes`` are the few a figure shows."""
    seen = x.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("w"))
    left = genes.crossJoin(F.broadcast(sizes)).join(seen.groupBy(*keys).agg(F.sum("w").alias("got")), keys, "left")
    zero = left.select(*keys, F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("got", F.lit(0))).alias("w")).where("w > 0")
    return seen.unionByName(zero)


def gene_quartiles(frame: CellFrame, genes: list, group_col: str, layer: str | None = None) -> DataFrame:
    """``(gene_id, group, n, low, q1, median, q3, high)`` of the named genes with zeros counted; unknown genes are an error."""
    frame.require_obs(group_col)
    named = frame.var.where(F.col("gene_id").isin(list(genes))).select("gene_id")
    if named.count() != len(set(genes)):
        raise KeyError("unknown gene among " + ", ".join(map(str, genes)))
    group = frame.obs.select("cell_id", F.col(group_col).alias("group"))
    x = frame.matrix(layer).join(F.broadcast(named), "gene_id", "left_semi").join(group, "cell_id")
    sizes = group.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    d = _with_zeros(x, ["gene_id", "group"], sizes, named)
    q = F.percentile("value", F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)]), F.col("w"))
    d = d.groupBy("gene_id", "group").agg(F.sum("w").alias("n"), F.min("value").alias("low"), q.alias("q"), F.max("value").alias("high"))
    return d.select("gene_id", "group", "n", "low", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))], "high")


def histograms(frame: CellFrame, n_genes: int = 5, bins: int = 30, layer: str | None = None) -> DataFrame:
    """``(gene_id, bin, lower, n)`` of the first genes: equal bins over each gene's range, the last one closed; a constant gene gets a range of one around it."""
    genes = frame.var.where(F.col("gene_ord") < n_genes).select("gene_id")
    x = frame.matrix(layer).join(F.broadcast(genes), "gene_id", "left_semi")
    d = _with_zeros(x, ["gene_id"], frame.obs.agg(F.count(F.lit(1)).alias("n")), genes)
    r = d.groupBy("gene_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("hi") == F.col("lo")
    r = r.select("gene_id", (F.col("lo") - F.when(flat, 0.5).otherwise(0.0)).alias("lo"), (F.col("hi") + F.when(flat, 0.5).otherwise(0.0)).alias("hi"))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    d = d.join(F.broadcast(r), "gene_id").groupBy("gene_id", b.alias("bin"), "lo", "hi").agg(F.sum("w").alias("n"))
    return d.select("gene_id", "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lower"), "n")


def last_merges(spark, z, last: int = 30) -> DataFrame:
    """``(step, a, b, height, size)``: the final merges of a linkage, for a truncated dendrogram."""
    rows = [(i, int(r[0]), int(r[1]), float(r[2]), int(r[3])) for i, r in enumerate(z)][-last:]
    return spark.createDataFrame(rows, "step int, a int, b int, height double, size int")
