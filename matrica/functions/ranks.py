"""Rank flavours and multiple-testing corrections as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def midrank(value: str | Column, keys: list[str] = ()) -> Column:
    """Average rank from 1; equal values share the mean of their places."""
    col = F.col(value) if isinstance(value, str) else value
    w = _part(list(keys))
    ties = F.count(F.lit(1)).over(w.orderBy(col).rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w.orderBy(col)) + (ties - 1) / 2.0


def min_rank(value: str, keys: list[str] = (), ascending: bool = True) -> Column:
    """Least place among equals; null stays null."""
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return F.when(F.col(value).isNotNull(), F.rank().over(_part(list(keys)).orderBy(order)))


def quality_rank(value: str, keys: list[str] = ()) -> Column:
    """(midrank - 0.5) / n over non-null values rounded to 12 decimals."""
    rounded = F.round(F.col(value), 12)
    w = _part([*keys])
    split = F.col(value).isNull()
    inner = Window.partitionBy(*(keys or [F.lit(0)]), split).orderBy(rounded)
    ties = F.count(F.lit(1)).over(inner.rangeBetween(Window.currentRow, Window.currentRow))
    mid = F.rank().over(inner) + (ties - 1) / 2.0
    return F.when(F.col(value).isNotNull(), (mid - 0.5) / F.count(value).over(w))


def adjust_pvalues(df: DataFrame, p: str = "p_value", method: str = "fdr_bh", out: str = "p_adjusted", keys: list[str] = (), tie: str | None = None) -> DataFrame:
    """Adjusted p-values within ``keys``; null p stays null and does not count.

    ``fdr_bh``, ``fdr_by``: cumulative minimum from the largest; ``holm``:
    cumulative maximum from the smallest; ``bonferroni``: p times n.
    """
    if method not in ("fdr_bh", "fdr_by", "holm", "bonferroni"):
        raise ValueError(f"unknown correction: {method}")
    part = [*keys, F.col(p).isNull()]
    n = F.count(p).over(Window.partitionBy(*part))
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))
    ties = [tie] if tie else []
    up = Window.partitionBy(*part).orderBy(F.col(p).asc(), *ties)
    place = F.row_number().over(up)
    ranked = df.withColumn("_n", n).withColumn("_i", place)
    if method == "holm":
        raw = F.col(p) * (F.col("_n") - F.col("_i") + 1)
        w = Window.partitionBy(*part).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        got = F.max(raw).over(w)
    else:
        factor = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i) if method == "fdr_by" else F.lit(1.0)
        w = Window.partitionBy(*part).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
        got = F.min(F.col(p) * F.col("_n") / F.col("_i") * factor).over(w)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), got))).drop("_n", "_i")


def hash_int(*parts: Column | int | str) -> Column:
    """A 32-bit integer from md5 of the parts joined by ':'; the same in any SQL engine."""
    cols = [c if isinstance(c, Column) else F.lit(str(c)) for c in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")
