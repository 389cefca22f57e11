"""Clusterings, their panel, consensus and internal metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points whose linkage may be worked out on the driver.
MAX_LINKAGE = 5000
#: Points whose neighbour graph may be optimised on the driver.
MAX_GRAPH = 200_000


def kmeans(points: DataFrame, k: int, init: str = "k-means||", spherical: bool = False, bisecting: bool = False, n_init: int = 3, seed: int = 42) -> tuple[DataFrame, float]:
    """``(cell_id, cluster)`` and the cost of the best of ``n_init`` runs."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    d = points.select("cell_id", array_to_vector("vec").alias("features"))
    if spherical:
        d = Normalizer(inputCol="features", outputCol="unit").transform(d).select("cell_id", F.col("unit").alias("features"))
    d = d.cache()
    best = None
    for s in range(n_init):
        m = (BisectingKMeans(k=k, seed=seed + s) if bisecting else KMeans(k=k, initMode=init, seed=seed + s)).fit(d)
        cost = m.summary.trainingCost
        if best is None or cost < best[1]:
            best = (m, cost)
    return best[0].transform(d).select("cell_id", F.col("prediction").cast("string").alias("cluster")), best[1]


def dbscan(points: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """``(cell_id, cluster)``, -1 noise; a point counts itself; border points join their least core cluster.

    The radius join is read off blocks of exact distances; core points are
    joined by least-label rounds.
    """
    from matrica.operators.neighbors import euclidean2

    a, b = points.select(F.col("cell_id").alias("a"), F.col("vec").alias("va")), points.select(F.col("cell_id").alias("b"), F.col("vec").alias("vb"))
    near = a.join(F.broadcast(b), euclidean2(F.col("va"), F.col("vb")) <= eps * eps).select("a", "b").cache()
    core = near.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_samples).select("a")
    e = near.join(core, "a").join(core.withColumnRenamed("a", "b"), "b")
    label = core.select("a", F.col("a").alias("l"))
    while True:
        new = e.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("l")).checkpoint() if points.sparkSession.sparkContext.getCheckpointDir() else points.sparkSession.createDataFrame(e.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("l")).toPandas(), "a bigint, l bigint")
        if not new.join(label.withColumnRenamed("l", "old"), "a").where("l <> old").limit(1).count():
            break
        label = new
    border = near.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("l"))
    got = points.select("cell_id").join(border.withColumnRenamed("a", "cell_id"), "cell_id", "left")
    return got.select("cell_id", F.when(F.col("l").isNull(), -1).otherwise(F.dense_rank().over(Window.orderBy(F.col("l").asc_nulls_last())) - 1).cast("string").alias("cluster"))


def estimate_eps(points: DataFrame, min_samples: int = 5) -> float:
    """Knee of the sorted distances to the k-th returned neighbour, the point itself included."""
    from matrica.operators.embeddings import elbow
    from matrica.operators.neighbors import knn

    d = knn(points, min_samples, include_self=True).where(F.col("rank") == min_samples)
    curve = d.select((F.row_number().over(Window.orderBy("dist", "src")) - 1).cast("double").alias("x"), F.col("dist").alias("y"))
    return float(elbow(curve).first()["y"])


def pair_distances(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(a, b, d)`` for a < b."""
    from matrica.operators.neighbors import distance

    a, b = points.select(F.col("cell_id").alias("a"), F.col("vec").alias("va")), points.select(F.col("cell_id").alias("b"), F.col("vec").alias("vb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", distance(F.col("va"), F.col("vb"), metric).alias("d"))


def linkage(d: np.ndarray, method: str = "complete") -> np.ndarray:
    """Merges ``(i, j, height, size)`` of a square distance matrix, nearest pair first."""
    n = len(d)
    if n > MAX_LINKAGE:
        raise ValueError(f"{n} points; linkage is sequential and stops at {MAX_LINKAGE}")
    d = d.astype(float).copy()
    if method == "ward":
        d = d * d
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b, si, sj = d[i], d[j], size[i], size[j]
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "average":
            new = (si * a + sj * b) / (si + sj)
        elif method == "ward":
            new = ((si + size) * a + (sj + size) * b - size * h) / (si + sj + size)
        else:
            raise ValueError(f"unknown linkage: {method}")
        out.append((*sorted((ids[i], ids[j])), np.sqrt(h) if method == "ward" else h, si + sj))
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        ids[i] = n + step
    return np.array(out)


def cut(z: np.ndarray, k: int) -> np.ndarray:
    """Labels from 0, in order of first member, of ``k`` clusters."""
    n = len(z) + 1
    parent = list(range(2 * n - 1))
    for s, (a, b, *_) in enumerate(z[: n - k]):
        parent[int(a)] = parent[int(b)] = n + s

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    names: dict[int, int] = {}
    return np.array([names.setdefault(root(i), len(names)) for i in range(n)])


def hierarchical(points: DataFrame, k: int, metric: str = "euclidean", method: str = "complete") -> DataFrame:
    """``(cell_id, cluster)``: distances in Spark, merges on the driver, size checked first."""
    if method == "ward" and metric != "euclidean":
        raise ValueError("ward needs euclidean distances")
    ids = [r[0] for r in points.select("cell_id").orderBy("cell_id").collect()] if points.count() <= MAX_LINKAGE else []
    if not ids:
        raise ValueError(f"more than {MAX_LINKAGE} points")
    at = {c: i for i, c in enumerate(ids)}
    d = np.zeros((len(ids), len(ids)))
    p = pair_distances(points, metric).toPandas()
    i, j = p["a"].map(at).to_numpy(), p["b"].map(at).to_numpy()
    d[i, j] = d[j, i] = p["d"].to_numpy()
    lab = cut(linkage(d, method), k)
    return points.sparkSession.createDataFrame(pd.DataFrame({"cell_id": ids, "cluster": [str(x) for x in lab]}))


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``(cell_id, cluster)`` by local moving and aggregation on modularity with a resolution.

    The edge list comes to the driver; its size is checked.
    """
    e = edges.select("src", "dst").toPandas() if edges.count() <= 64 * MAX_GRAPH else None
    if e is None:
        raise ValueError("too many edges for the driver")
    ids = np.unique(e.to_numpy())
    u, v = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])
    member = np.arange(len(ids))
    adj: list[dict[int, float]] = [{} for _ in ids]
    for a, b in zip(u, v):
        if a != b:
            adj[a][b] = adj[b][a] = 1.0
    loops = np.zeros(len(ids))
    rng = np.random.default_rng(seed)
    while True:
        n = len(adj)
        deg = np.array([sum(x.values()) for x in adj]) + 2 * loops
        m2 = deg.sum() or 1.0
        com, tot = np.arange(n), deg.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for x in rng.permutation(n):
                w: dict[int, float] = {}
                for y, val in adj[x].items():
                    w[com[y]] = w.get(com[y], 0.0) + val
                c = com[x]
                tot[c] -= deg[x]
                best, gain = c, w.get(c, 0.0) - resolution * deg[x] * tot[c] / m2
                for q in sorted(w):
                    g = w[q] - resolution * deg[x] * tot[q] / m2
                    if g > gain + 1e-12:
                        best, gain = q, g
                tot[best] += deg[x]
                if best != c:
                    com[x] = best
                    moved = moved_any = True
        _, com = np.unique(com, return_inverse=True)
        member = com[member]
        if not moved_any:
            break
        k = com.max() + 1
        new: list[dict[int, float]] = [{} for _ in range(k)]
        nl = np.zeros(k)
        np.add.at(nl, com, loops)
        for x in range(n):
            for y, val in adj[x].items():
                if com[x] == com[y]:
                    nl[com[x]] += val / 2
                else:
                    new[com[x]][com[y]] = new[com[x]].get(com[y], 0.0) + val
        adj, loops = new, nl
    order = np.argsort(-np.bincount(member), kind="stable")
    name = np.empty_like(order)
    name[order] = np.arange(len(order))
    return edges.sparkSession.createDataFrame(pd.DataFrame({"cell_id": ids, "cluster": [str(name[x]) for x in member]}))


def co_occurrence(assignments: DataFrame) -> DataFrame:
    """``(a, b, share)``: in what share of runs two cells share a cluster, -1 left out.

    Joined on (run, cluster) with each cell's list of all of them: a pair comes
    out once, at the first it has in common, so pairs are not shuffled or counted.
    """
    runs = [r[0] for r in assignments.select("run").distinct().collect()]
    named = assignments.where(F.col("cluster") != "-1").select("cell_id", "run", "cluster").distinct()
    code = named.select("run", "cluster").distinct().withColumn("k", F.row_number().over(Window.orderBy("run", "cluster")))
    held = named.join(F.broadcast(code), ["run", "cluster"]).groupBy(F.col("cell_id").alias("c")).agg(F.array_sort(F.collect_list("k")).alias("in"))
    each = held.select("c", "in", F.explode("in").alias("at"))
    l, r = each.select("at", F.col("c").alias("a"), F.col("in").alias("ia")), each.select("at", F.col("c").alias("b"), F.col("in").alias("ib"))
    both = F.array_intersect("ia", "ib")
    return l.join(r, "at").where((F.col("a") < F.col("b")) & (F.array_min(both) == F.col("at"))).select("a", "b", (F.size(both) / len(runs)).alias("share"))


def weighted_assembly(similarities: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(a, b, similarity)`` of ``(name, a, b, s)``: weighted mean over names."""
    w = F.lit(1.0)
    for k, v in (weights or {}).items():
        w = F.when(F.col("name") == k, v).otherwise(w)
    total = sum((weights or {}).get(r[0], 1.0) for r in similarities.select("name").distinct().collect())
    if not total and not similarities.limit(1).count():
        raise ValueError("no similarity to assemble")
    return similarities.groupBy("a", "b").agg((F.sum(F.col("s") * w) / max(total, 1e-8)).alias("similarity"))


def centroids(points: DataFrame) -> DataFrame:
    """``(cluster, n, centre array)`` of ``(cell_id, vec, cluster)``."""
    e = points.select("cluster", F.posexplode("vec").alias("j", "v"))
    m = e.groupBy("cluster", "j").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("centre"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    from matrica.operators.neighbors import euclidean2

    c = centroids(points)
    whole = centroids(points.withColumn("cluster", F.lit("all"))).select(F.col("centre").alias("g"))
    b = c.join(F.broadcast(whole)).agg(F.sum(F.col("n") * euclidean2(F.col("centre"), F.col("g"))).alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    w = points.join(F.broadcast(c), "cluster").agg(F.sum(euclidean2(F.col("vec"), F.col("centre"))).alias("w"))
    return b.join(w).select(F.try_divide(F.try_divide("b", F.col("k") - 1), F.try_divide("w", F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    from matrica.operators.neighbors import euclidean2

    c = centroids(points)
    s = points.join(F.broadcast(c), "cluster").groupBy("cluster").agg(F.avg(F.sqrt(euclidean2(F.col("vec"), F.col("centre")))).alias("s")).join(c, "cluster")
    a, b = s.alias("a"), s.alias("b")
    r = F.try_divide(F.col("a.s") + F.col("b.s"), F.sqrt(euclidean2(F.col("a.centre"), F.col("b.centre"))))
    return a.join(b, F.col("a.cluster") != F.col("b.cluster")).groupBy("a.cluster").agg(F.max(r).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def panel(points: DataFrame, labels: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Assignments ``(method, cell_id, cluster)`` and results ``(method, status,
    failure_reason, n_clusters, noise, ari, nmi)``; failures keep their row;
    over half noise leaves the scores null."""
    from matrica.operators.contingency import agreement

    spark = points.sparkSession
    rows, assigned = [], None
    for name, run in methods.items():
        try:
            got = run(points).cache()
            j = got.join(labels, "cell_id")
            n = j.count()
            ok = j.where("cluster <> '-1'")
            noise = 1 - ok.count() / max(n, 1)
            s = agreement(ok, "label", "cluster").first() if noise <= 0.5 else None
            rows.append((name, "ok", "", got.where("cluster <> '-1'").select("cluster").distinct().count(), float(noise), s and float(s["ari"]), s and float(s["nmi"])))
            part = got.select(F.lit(name).alias("method"), "cell_id", "cluster")
            assigned = part if assigned is None else assigned.unionByName(part)
        except MemoryError:
            raise
        except Exception as e:  # the row stays, with its reason
            rows.append((name, "failed", f"{type(e).__name__}: {e}"[:300], None, None, None, None))
    return assigned, spark.createDataFrame(rows, "method string, status string, failure_reason string, n_clusters int, noise double, ari double, nmi double")


def top_clusterings(results: DataFrame, n: int = 6) -> DataFrame:
    """The best by ARI, ties by name, ranked from 1."""
    r = F.row_number().over(Window.orderBy(F.desc_nulls_last("ari"), "method"))
    return results.where("ari is not null").withColumn("rank", r).where(F.col("rank") <= n)
