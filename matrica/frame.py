"""The data model: an annotated matrix as a set of DataFrames."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("matrica")
#: Dense grids larger than this are announced before they are made.
DENSE_WARNING_GB = 4.0


@dataclass(frozen=True)
class CellFrame:
    """``x(cell_id, gene_id, value)`` holds non-zeros, absent means 0;
    ``obs(cell_id, ...)``, ``var(gene_id, gene_ord, ...)``; ``obsm`` name to
    ``(cell_id, vec array<double>)``; ``layers`` name to a long matrix.
    Frames are never changed in place: every operator returns a new one."""

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    layers: dict[str, DataFrame] = field(default_factory=dict)
    provenance: dict[str, dict[str, str]] = field(default_factory=dict)

    def matrix(self, layer: str | None = None) -> DataFrame:
        if layer is None:
            return self.x
        if layer not in self.layers:
            raise KeyError(f"no layer {layer!r}; have {sorted(self.layers)}")
        return self.layers[layer]

    def require_obs(self, *cols: str) -> None:
        missing = [c for c in cols if c not in self.obs.columns]
        if missing:
            raise KeyError(f"no obs column {missing}; have {self.obs.columns}")

    def with_layer(self, name: str, x: DataFrame) -> CellFrame:
        return replace(self, layers=self.layers | {name: x})

    def with_obsm(self, name: str, rep: DataFrame) -> CellFrame:
        return replace(self, obsm=self.obsm | {name: rep})

    def with_obs(self, columns: DataFrame) -> CellFrame:
        """Join new per-cell columns; columns of the same name are replaced."""
        new = [c for c in columns.columns if c != "cell_id"]
        return replace(self, obs=self.obs.drop(*new).join(columns, "cell_id", "left"))

    def record(self, key: str, **params) -> CellFrame:
        return replace(self, provenance=self.provenance | {key: {k: repr(v) for k, v in params.items() if v is not None}})

    def n_cells(self) -> int:
        return self.obs.count()

    def n_genes(self) -> int:
        return self.var.count()

    def dense(self, layer: str | None = None) -> DataFrame:
        """Every (cell, gene) with zeros filled in; announced when large.

        The grid is built by exploding the gene list, which is broadcast, per
        cell; use it only where a result is dense by nature.
        """
        n, p = self.n_cells(), self.n_genes()
        if n * p * 8 > DENSE_WARNING_GB * 2**30:
            log.warning("dense grid of %d x %d", n, p)
        genes = [r[0] for r in self.var.select("gene_id").orderBy("gene_ord").collect()]
        grid = self.obs.select("cell_id", F.explode(F.array(*[F.lit(g) for g in genes])).alias("gene_id"))
        return grid.join(self.matrix(layer), ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def from_long(x: DataFrame, obs: DataFrame | None = None, var: DataFrame | None = None) -> CellFrame:
    """A frame from a long matrix; zeros and NaN are taken out, NaN means missing."""
    clean = x.select("cell_id", "gene_id", F.col("value").cast("double").alias("value")).where((F.col("value") != 0) & ~F.isnan("value"))
    obs = obs if obs is not None else x.select("cell_id").distinct()
    if var is None:
        var = x.select("gene_id").distinct()
    if "gene_ord" not in var.columns:
        from pyspark.sql import Window

        var = var.withColumn("gene_ord", F.row_number().over(Window.orderBy("gene_id")) - 1)
    return CellFrame(clean, obs, var)


def from_wide(df: DataFrame, cell_id: str, target_col: str | None = None) -> CellFrame:
    """Numeric columns become genes, the others obs; ``target_col`` stays obs even if numeric."""
    number = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    genes = [c for c, t in df.dtypes if c not in (cell_id, target_col) and (t in number or t.startswith("decimal"))]
    rest = [c for c in df.columns if c not in genes and c != cell_id]
    x = df.select(F.col(cell_id).alias("cell_id"), *[F.col(c).cast("double").alias(c) for c in genes]).unpivot("cell_id", genes, "gene_id", "value")
    spark = df.sparkSession
    var = spark.createDataFrame(list(zip(genes, range(len(genes)))), "gene_id string, gene_ord int")
    return from_long(x, df.select(F.col(cell_id).alias("cell_id"), *rest), var)


def pick_modality(frames: dict[str, CellFrame], modality: str | None = None) -> CellFrame:
    """One frame of several; must be named if there are more than one."""
    if modality is None:
        if len(frames) != 1:
            raise ValueError(f"name a modality: {sorted(frames)}")
        return next(iter(frames.values()))
    if modality not in frames:
        raise KeyError(f"no modality {modality!r}; have {sorted(frames)}")
    return frames[modality]
