"""The whole label-quality analysis: two arms, then the scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.operators import classification, clustering, neighbors, quality


def default_clusterings(k: int, seed: int = 42) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The fast panel: k-means variants and communities of the neighbour graph."""
    return {
        "kmeans": lambda p: clustering.kmeans(p, k, seed=seed)[0],
        "kmeans_spherical": lambda p: clustering.kmeans(p, k, spherical=True, seed=seed)[0],
        "kmeans_bisecting": lambda p: clustering.kmeans(p, k, bisecting=True, seed=seed)[0],
    } | {f"communities_{r}": (lambda p, r=r: clustering.communities(neighbors.knn(p, 15), r, seed)) for r in (0.5, 1.0, 1.5)}


def unsupervised(points: DataFrame, clusterings: dict | None = None, top: int = 6) -> tuple[DataFrame, DataFrame]:
    """Per-cell ``top{k}_confusion`` and ``top{k}_fragmentation`` of the best clusterings, and the results table.

    One neighbour table serves all clusterings.
    """
    labels = points.select("cell_id", "label")
    k = labels.select("label").distinct().count()
    assigned, results = clustering.panel(points, labels, clusterings or default_clusterings(k))
    best = clustering.top_clusterings(results, top).select("method", "rank")
    m = assigned.join(F.broadcast(best), "method").join(labels, "cell_id").select("cell_id", "label", F.concat(F.lit("top"), F.col("rank")).alias("method"), "cluster")
    n = min(50, points.count() - 1)
    conf = neighbors.confusion(neighbors.knn(points.select("cell_id", "vec"), n), m, n)
    frag = neighbors.fragmentation(m, ["method"])
    names = [f"top{r['rank']}" for r in best.orderBy("rank").collect()]
    out = labels
    for df, col in ((conf, "confusion"), (frag, "fragmentation")):
        wide = df.groupBy("cell_id").pivot("method", names).agg(F.first(col))
        out = out.join(wide.select("cell_id", *[F.col(x).alias(f"{x}_{col}") for x in names]), "cell_id")
    return out, results


def supervised(points: DataFrame, models: list[str] | None = None, test_share: int = 5, seed: int = 42) -> DataFrame:
    """Consistency columns over all cells of models fitted on the training folds; a failing model is skipped."""
    d = classification.stratified_folds(points, "label", "cell_id", test_share, seed).cache()
    out, failed = None, {}
    for name in models or ["LogisticRegression", "NaiveBayes", "KNN"]:
        try:
            p = classification.predict(d.where("fold <> 0"), d, name, seed).withColumn("model", F.lit(name))
        except MemoryError:
            raise
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {e}"
            continue
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise RuntimeError(f"every model failed: {failed}")
    return quality.consensus(out)


def label_quality(points: DataFrame, clusterings: dict | None = None, models: list[str] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """``points`` ``(cell_id, vec, label)`` to scores, ranks and the clustering table."""
    cells, results = unsupervised(points, clusterings)
    cells = cells.join(supervised(points, models, seed=seed), "cell_id")
    conf = sorted(c for c in cells.columns if c.endswith("_confusion"))
    frag = sorted(c for c in cells.columns if c.endswith("_fragmentation"))
    means = quality.label_means(cells, "label", [*conf, *frag, *quality.SUPERVISED])
    sil = neighbors.silhouette(points.select("cell_id", "vec", F.col("label").alias("cluster"))).groupBy(F.col("cluster").alias("label")).agg(F.avg("silhouette").alias("silhouette"))
    scores = quality.variants(means.join(sil, "label", "left"), conf, frag)
    return {"cells": cells, "scores": scores, "ranks": quality.review_ranks(scores), "clusterings": results}
