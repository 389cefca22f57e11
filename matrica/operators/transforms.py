"""Normalisation of count matrices: a registry of long-matrix transforms.

Each takes a CellFrame and returns one whose ``x`` is the transformed matrix.
Those that keep zero at zero never leave the long form; the others build the
dense grid because their result is dense.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.frame import CellFrame

REGISTRY: dict[str, Callable[[CellFrame], CellFrame]] = {}
#: These may stay sparse.
ZERO_PRESERVING = {"log_shift_size_factor", "arcsinh", "log_alpha", "log_cpm", "log_shift_scale_by_std", "scran"}


def register(name: str):
    def add(fn):
        REGISTRY[name] = fn
        return fn

    return add


def transform(frame: CellFrame, name: str, layer: str | None = None, out_layer: str | None = None, **kw) -> CellFrame:
    """Run a registered transform on ``layer``; the result is ``x`` or ``out_layer``."""
    if name not in REGISTRY:
        raise KeyError(f"no transform {name!r}; have {sorted(REGISTRY)}")
    got = REGISTRY[name](replace(frame, x=frame.matrix(layer)), **kw).record(f"transform:{name}", layer=layer, **kw)
    return frame.with_layer(out_layer, got.x) if out_layer else got


def _total(x: DataFrame) -> DataFrame:
    """Adds the row total ``t``; a total of 0 counts as 1."""
    t = F.sum("value").over(Window.partitionBy("cell_id"))
    return x.withColumn("t", F.when(t == 0, 1.0).otherwise(t))


def _map(frame: CellFrame, value) -> CellFrame:
    return replace(frame, x=frame.x.select("cell_id", "gene_id", value.alias("value")))


def gene_moments(x: DataFrame, n: int) -> DataFrame:
    """Per gene mean and population standard deviation over all ``n`` cells, absent ones being 0."""
    s = x.groupBy("gene_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    var = F.greatest(F.lit(0.0), F.col("s2") / n - (F.col("s1") / n) * (F.col("s1") / n))
    return s.select("gene_id", (F.col("s1") / n).alias("mean"), F.sqrt(var).alias("sd"), var.alias("var"))


@register("log_shift_size_factor")
def log_shift_size_factor(frame: CellFrame) -> CellFrame:
    return replace(frame, x=_total(frame.x).select("cell_id", "gene_id", F.log1p(F.col("value") / F.col("t")).alias("value")))


@register("arcsinh")
def arcsinh(frame: CellFrame, alpha: float = 0.05) -> CellFrame:
    return _map(frame, F.asinh(F.lit(alpha) * F.col("value")))


@register("log_alpha")
def log_alpha(frame: CellFrame, alpha: float = 0.05) -> CellFrame:
    return _map(frame, F.log1p(F.lit(alpha) * F.col("value")))


@register("log_cpm")
def log_cpm(frame: CellFrame) -> CellFrame:
    return replace(frame, x=_total(frame.x).select("cell_id", "gene_id", F.log1p(F.col("value") / F.col("t") * 1e6).alias("value")))


@register("log_shift_scale_by_std")
def log_shift_scale_by_std(frame: CellFrame) -> CellFrame:
    logged = frame.x.select("cell_id", "gene_id", F.log1p("value").alias("value"))
    sd = gene_moments(logged, frame.n_cells()).select("gene_id", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd"))
    return replace(frame, x=logged.join(sd, "gene_id").select("cell_id", "gene_id", (F.col("value") / F.col("sd")).alias("value")))


def top_variance_genes(frame: CellFrame, top_frac: float = 0.35) -> DataFrame:
    """Genes with the largest population variance, ties by gene id."""
    keep = max(1, int(frame.n_genes() * top_frac))
    var = frame.var.select("gene_id").join(gene_moments(frame.x, frame.n_cells()), "gene_id", "left").select("gene_id", F.coalesce("var", F.lit(0.0)).alias("var"))
    return var.orderBy(F.desc("var"), "gene_id").limit(keep)


@register("log_shift_size_factor_hvg")
def log_shift_size_factor_hvg(frame: CellFrame, top_frac: float = 0.35) -> CellFrame:
    got = log_shift_size_factor(frame)
    genes = top_variance_genes(got, top_frac).select("gene_id")
    return replace(got, x=got.x.join(F.broadcast(genes), "gene_id", "left_semi"), var=got.var.join(genes, "gene_id", "left_semi"))


def zscore(frame: CellFrame) -> CellFrame:
    """Per gene (x - mean) / sd over all cells; dense; sd 0 counts as 1."""
    m = gene_moments(frame.x, frame.n_cells())
    z = frame.dense().join(F.broadcast(m), "gene_id", "left")
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    return replace(frame, x=z.select("cell_id", "gene_id", ((F.col("value") - F.coalesce("mean", F.lit(0.0))) / sd).alias("value")))


@register("log_shift_size_factor_z")
def log_shift_size_factor_z(frame: CellFrame) -> CellFrame:
    return zscore(log_shift_size_factor(frame))


@register("log_shift_hvg_z")
def log_shift_hvg_z(frame: CellFrame, top_frac: float = 0.35) -> CellFrame:
    return zscore(log_shift_size_factor_hvg(frame, top_frac))


@register("scran")
def scran(frame: CellFrame) -> CellFrame:
    """log1p(x / sf), sf = total over the geometric mean of all totals (zero totals count as 1)."""
    totals = frame.obs.select("cell_id").join(frame.x.groupBy("cell_id").agg(F.sum("value").alias("t")), "cell_id", "left").select("cell_id", F.when(F.coalesce("t", F.lit(0.0)) == 0, 1.0).otherwise(F.col("t")).alias("t"))
    mean = totals.agg(F.exp(F.avg(F.log(F.col("t") + 1e-8))).alias("g")).first()["g"]
    return replace(frame, x=_total(frame.x).select("cell_id", "gene_id", F.log1p(F.col("value") / (F.col("t") / F.lit(mean))).alias("value")))


@register("tmm")
def tmm(frame: CellFrame) -> CellFrame:
    """Trimmed mean of M values against the cell at the 75 % place of library size; dense.

    Values equal to 9 decimals are ties, ordered by gene id."""
    n = frame.n_cells()
    y = frame.dense().withColumn("y", F.col("value") + 0.5)
    lib = y.groupBy("cell_id").agg(F.sum("y").alias("lib"))
    place = Window.orderBy("lib", "cell_id")
    ref_id = lib.withColumn("i", F.row_number().over(place) - 1).where(F.col("i") == int(0.75 * n)).first()["cell_id"]
    y = y.join(lib, "cell_id").withColumn("r", F.col("y") / F.col("lib"))
    ref = y.where(F.col("cell_id") == F.lit(ref_id)).select("gene_id", F.col("r").alias("r_ref"), F.col("y").alias("y_ref"), F.col("lib").alias("lib_ref"))
    ma = y.join(F.broadcast(ref), "gene_id").select(
        "cell_id", "gene_id", F.log2(F.col("r") / F.col("r_ref")).alias("m"), (0.5 * F.log2(F.col("r") * F.col("r_ref"))).alias("a"),
        (1.0 / ((F.col("lib") - F.col("y")) / (F.col("lib") * F.col("y")) + (F.col("lib_ref") - F.col("y_ref")) / (F.col("lib_ref") * F.col("y_ref")) + 1e-8)).alias("w"),
    )
    p = frame.n_genes()
    lo, hi = int(0.3 * p), int(0.7 * p)
    cell = Window.partitionBy("cell_id")
    ranked = ma.withColumn("im", F.row_number().over(cell.orderBy(F.round("m", 9), "gene_id")) - 1).withColumn("ia", F.row_number().over(cell.orderBy(F.round("a", 9), "gene_id")) - 1)
    in_m = (F.col("im") >= lo) & (F.col("im") < hi)
    both = in_m & (F.col("ia") >= lo) & (F.col("ia") < hi)
    counted = ranked.withColumn("both", both).withColumn("nb", F.sum(both.cast("int")).over(cell))
    used = F.when(F.col("nb") < 3, in_m).otherwise(F.col("both"))
    f = counted.where(used).groupBy("cell_id").agg(F.pow(F.lit(2.0), F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("f"))
    f = frame.obs.select("cell_id").join(f, "cell_id", "left").select("cell_id", F.coalesce("f", F.lit(1.0)).alias("f"))
    mean = f.agg(F.exp(F.avg(F.log(F.col("f") + 1e-8))).alias("g")).first()["g"]
    return replace(frame, x=frame.x.join(f, "cell_id").select("cell_id", "gene_id", F.log1p(F.col("value") / (F.col("f") / F.lit(mean))).alias("value")))


def boxcox_lambda(v: np.ndarray, times: np.ndarray | None = None) -> float:
    """Maximum-likelihood lambda by golden section over [-5, 5] of values that occur ``times`` each."""
    times = np.ones(len(v)) if times is None else times
    lx, n = np.log(v), times.sum()
    sl = (lx * times).sum()

    def loss(lam: float) -> float:
        y = lx if abs(lam) < 1e-12 else np.expm1(lam * lx) / lam
        s = (times * (y - (times * y).sum() / n) ** 2).sum() / n
        return np.inf if not np.isfinite(s) or s <= 0 else 0.5 * n * np.log(s) - (lam - 1) * sl

    a, b, g = -5.0, 5.0, (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(80):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return (a + b) / 2


@register("box_cox")
def box_cox(frame: CellFrame) -> CellFrame:
    """Per gene Box-Cox at its most likely lambda; near-constant genes stay as they are; dense.

    A gene is fitted on its values and how often each occurs, and cells look
    their value up, so that no task holds a gene's cells.
    """
    dense = frame.dense()

    def one(table: pa.Table) -> pa.Table:
        v, times = table.column("value").to_numpy(), table.column("times").to_numpy()
        mean = (v * times).sum() / times.sum()
        y = v
        if ((v - mean) ** 2 * times).sum() / times.sum() >= 1e-20:
            s = v - v.min() + 1 if v.min() <= 0 else v
            lam = boxcox_lambda(s, times)
            y = np.log(s) if abs(lam) < 1e-12 else np.expm1(lam * np.log(s)) / lam
            y = y if np.isfinite(y).all() else v
        return pa.table({"gene_id": table.column("gene_id"), "value": v, "y": y})

    kind = dict(dense.dtypes)["gene_id"]
    seen = dense.groupBy("gene_id", "value").agg(F.count(F.lit(1)).alias("times"))
    map_ = seen.groupBy("gene_id").applyInArrow(one, f"gene_id {kind}, value double, y double")
    return replace(frame, x=dense.join(map_, ["gene_id", "value"]).select("cell_id", "gene_id", F.col("y").alias("value")))


@register("pearson_residuals")
def pearson_residuals(frame: CellFrame, theta: float = 100.0) -> CellFrame:
    """Clipped residuals of a negative binomial with means from the margins; dense."""
    n = frame.n_cells()
    rows = frame.x.groupBy("cell_id").agg(F.sum("value").alias("t"))
    cols = frame.x.groupBy("gene_id").agg(F.sum("value").alias("g"))
    total = frame.x.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s")).first()["s"]
    d = frame.dense().join(rows, "cell_id", "left").join(F.broadcast(cols), "gene_id", "left")
    mu = F.coalesce("t", F.lit(0.0)) * F.coalesce("g", F.lit(0.0)) / F.lit(total + 1e-10)
    d = d.withColumn("mu", mu)
    z = (F.col("value") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / theta + 1e-10)
    edge = float(np.sqrt(n))
    return replace(frame, x=d.select("cell_id", "gene_id", F.greatest(F.lit(-edge), F.least(F.lit(edge), z)).alias("value")))


@register("sanity")
def sanity(frame: CellFrame) -> CellFrame:
    """ln(x / t + n / T); dense."""
    n = frame.n_cells()
    total = frame.x.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s")).first()["s"]
    rows = frame.x.groupBy("cell_id").agg(F.sum("value").alias("t"))
    d = frame.dense().join(rows, "cell_id", "left")
    t = F.when(F.coalesce("t", F.lit(0.0)) == 0, 1.0).otherwise(F.col("t"))
    return replace(frame, x=d.select("cell_id", "gene_id", F.log(F.col("value") / t + F.lit(n / (total + 1e-10))).alias("value")))


@register("glm_pca")
def glm_pca(frame: CellFrame, n_components: int = 50) -> CellFrame:
    """log1p of counts per 10,000, projected on the leading right singular vectors (not centred)."""
    logged = replace(frame, x=_total(frame.x).select("cell_id", "gene_id", F.log1p(F.col("value") / F.col("t") * 1e4).alias("value")))
    k = max(1, min(n_components, frame.n_cells() - 1, frame.n_genes() - 1))
    from matrica.operators.embeddings import gram_components

    load = gram_components(logged, k, centre=False)["loadings"]
    long = logged.x.join(F.broadcast(load), "gene_id").select("cell_id", F.posexplode("loadings").alias("pc", "w"), "value")
    x = long.groupBy("cell_id", "pc").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    x = x.select("cell_id", F.concat(F.lit("PC"), F.col("pc") + 1).alias("gene_id"), "value")
    var = x.sparkSession.createDataFrame([(f"PC{j + 1}", j) for j in range(k)], "gene_id string, gene_ord int")
    return replace(frame, x=x, var=var)
