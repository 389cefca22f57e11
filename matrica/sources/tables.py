"""Readers and writers of annotated matrices and result tables."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrica.frame import CellFrame, from_wide


def read_cells(spark: SparkSession, path: str) -> CellFrame:
    """A frame written by ``write_cells``: parquet folders x, obs, var, obsm_*, layer_*."""
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    parts = {r["kind"]: r["names"] for r in read("parts").collect()}
    return CellFrame(read("x"), read("obs"), read("var"), {k: read(f"obsm_{k}") for k in parts.get("obsm", [])}, {k: read(f"layer_{k}") for k in parts.get("layers", [])})


def write_cells(frame: CellFrame, path: str) -> None:
    parts = {"x": frame.x, "obs": frame.obs, "var": frame.var} | {f"obsm_{k}": v for k, v in frame.obsm.items()} | {f"layer_{k}": v for k, v in frame.layers.items()}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    parts = [("obsm", sorted(frame.obsm)), ("layers", sorted(frame.layers))]
    frame.x.sparkSession.createDataFrame(parts, "kind string, names array<string>").write.mode("overwrite").parquet(f"{path}/parts")


def read_csv(spark: SparkSession, path: str, index_col: int = 0, transpose: bool = False, sep: str = ",", target_col: str | None = None) -> CellFrame:
    """A CSV whose first column names the rows; ``transpose`` when rows are genes."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    frame = from_wide(df, df.columns[index_col], target_col)
    if not transpose:
        return frame
    x = frame.x.select(F.col("gene_id").alias("cell_id"), F.col("cell_id").cast("string").alias("gene_id"), "value")
    genes = frame.obs.select(F.col("cell_id").cast("string").alias("gene_id")).withColumn("gene_ord", F.monotonically_increasing_id())
    return CellFrame(x, frame.var.select(F.col("gene_id").alias("cell_id")), genes)


def load(spark: SparkSession, path: str, **kw) -> CellFrame:
    """By suffix: csv, tsv or txt, else a folder of parquet tables; other suffixes are an error."""
    end = os.path.splitext(path.rstrip("/"))[1].lower()
    if end == ".csv":
        return read_csv(spark, path, **kw)
    if end in (".tsv", ".txt"):
        return read_csv(spark, path, sep="\t", **kw)
    if end in ("", ".cells", ".parquet"):
        return read_cells(spark, path)
    raise ValueError(f"unknown format: {end}")


def read_modalities(spark: SparkSession, path: str, names: list[str]) -> dict[str, CellFrame]:
    """Frames of one multi-modal folder, one sub-folder each."""
    return {n: read_cells(spark, f"{path}/{n}") for n in names}


def load_modality(spark: SparkSession, path: str, modality: str | None = None, **kw) -> CellFrame:
    """``load``, or the named sub-folder of a multi-modal folder."""
    return load(spark, path, **kw) if modality is None else read_cells(spark, f"{path}/{modality}")


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _plain(x):
    if isinstance(x, DataFrame):
        rows = x.collect()
        return {c: [_plain(r[c]) for r in rows] for c in x.columns}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    return None if isinstance(x, float) and not math.isfinite(x) else x


def save_json(results: dict, path: str, indent: int = 2) -> None:
    """Small results; frames become lists by column, NaN becomes null."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(_plain(results), f, indent=indent, default=str)
