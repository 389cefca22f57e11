"""Batch correction: empirical Bayes, iterative soft clusters, mutual neighbours, and a component regression score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.frame import CellFrame
from matrica.operators import neighbors
from matrica.operators.layouts import _squared, _table
from matrica.operators.tests_de import moments

#: Points whose embedding may be corrected on the driver (a points by components matrix).
MAX_CELLS = 200_000


def combat(frame: CellFrame, batch_col: str, layer: str | None = None, key_added: str = "combat") -> CellFrame:
    """Location and scale per batch shrunk over genes, as a dense layer.

    Moments per gene and batch are sums in Spark; the shrinkage works on one
    number per gene and batch; the correction goes back by a join.
    """
    m = moments(frame, batch_col, None, layer).toPandas().sort_values(["gene_id", "grp"])
    genes, batches = sorted(m["gene_id"].unique()), sorted(m["grp"].unique())
    if len(batches) < 2:
        raise ValueError("two batches are needed")
    grid = lambda c: m[c].to_numpy(float).reshape(len(genes), len(batches))
    n, mean, var = grid("n"), grid("mean"), np.nan_to_num(grid("var"))
    total = n.sum(1, keepdims=True)
    grand = (n * mean).sum(1, keepdims=True) / total
    pooled = ((n - 1) * var).sum(1, keepdims=True) / total
    sd = np.where(pooled > 0, np.sqrt(pooled), 1.0)
    gamma_hat, delta_hat = (mean - grand) / sd, var / sd**2
    shift, scale = np.zeros_like(mean), np.ones_like(mean)
    use = pooled[:, 0] > 0  # genes without variance stay as they are
    for b in range(len(batches) if use.any() else 0):
        g, d, size = gamma_hat[use, b], delta_hat[use, b], n[use, b]
        g_bar, t2 = g.mean(), max(g.var(ddof=1) if len(g) > 1 else 0.0, 1e-12)
        mu, s2 = d.mean(), max(d.var(ddof=1) if len(d) > 1 else 0.0, 1e-12)
        alpha, rate = (2 * s2 + mu**2) / s2, (mu * s2 + mu**3) / s2
        g_new, d_new = g.copy(), np.maximum(d, 1e-12)
        for _ in range(200):
            g_next = (t2 * size * g + d_new * g_bar) / (t2 * size + d_new)
            square = (size - 1) * d + size * (g - g_next) ** 2
            d_next = np.maximum((0.5 * square + rate) / (size / 2 + alpha - 1), 1e-12)
            moved = max(np.abs(g_next - g_new).max(), np.abs(d_next / d_new - 1).max())
            g_new, d_new = g_next, d_next
            if moved < 1e-6:
                break
        shift[use, b], scale[use, b] = g_new, np.sqrt(d_new)
    rows = [(gene, batch, float(grand[i, 0]), float(sd[i, 0]), float(shift[i, b]), float(scale[i, b])) for i, gene in enumerate(genes) for b, batch in enumerate(batches)]
    spark, kind = frame.x.sparkSession, dict(frame.var.dtypes)["gene_id"]
    fit = spark.createDataFrame(rows, f"gene_id {kind}, _b string, grand double, sd double, shift double, scale double")
    obs = frame.obs.select("cell_id", F.col(batch_col).cast("string").alias("_b"))
    d = frame.dense(layer).join(obs, "cell_id").join(fit, ["gene_id", "_b"])
    value = ((F.col("value") - F.col("grand")) / F.col("sd") - F.col("shift")) / F.col("scale") * F.col("sd") + F.col("grand")
    return frame.with_layer(key_added, d.select("cell_id", "gene_id", value.alias("value"))).record("combat", batch=batch_col)


def _with_batches(points: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    n = points.count()
    if n > MAX_CELLS:
        raise ValueError(f"{n} points; at most {MAX_CELLS} are corrected together")
    rows = points.select("cell_id", "vec", F.col("batch").cast("string")).orderBy("cell_id").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def harmony(points: DataFrame, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 10, seed: int = 42) -> DataFrame:
    """``(cell_id, vec)`` of ``(cell_id, vec, batch)``: soft clusters that favour mixed batches, then a ridge regression on the batch per cluster.

    Each step is a sum over points that fits in clusters by batches by
    components; few points are summed on the driver, more in Spark.
    """
    kind = dict(points.dtypes)["cell_id"]
    sizes = {r[0]: r[1] for r in points.groupBy(F.col("batch").cast("string")).count().collect()}
    names = sorted(sizes)
    n, width = sum(sizes.values()), points.agg(F.max(F.size("vec"))).first()[0]
    share, k = np.array([sizes[b] for b in names]) / n, max(2, min(100, n // 30))
    code = (F.array_position(F.array(*[F.lit(b) for b in names]), F.col("batch").cast("string")) - 1).cast("int")
    rows = points.select("cell_id", "vec", code.alias("code"), F.col("vec").alias("out"))
    pick = np.random.default_rng(seed).choice(n, k, replace=False)
    few = n * width * 8 <= neighbors.BLOCK_BYTES
    if few:
        got = rows.orderBy("cell_id").collect()
        ids, z, codes = [r[0] for r in got], np.array([r[1] for r in got], float), np.array([r[2] for r in got])
        out = z.copy()
        centre = _unit(z[pick])
    else:
        rows = neighbors.dealt(rows, n, 2 * width).persist()
        at = {int(i): j for j, i in enumerate(pick)}
        place = {r[0][0]: at[r[1]] for r in rows.select("cell_id").orderBy("cell_id").rdd.zipWithIndex().filter(lambda r: r[1] in at).collect()}
        start = {place[r[0]]: r[1] for r in rows.where(F.col("cell_id").isin(list(place))).select("cell_id", "vec").collect()}
        centre = _unit(np.array([start[j] for j in range(k)], float))

    def weights(u: np.ndarray, own: np.ndarray, centre: np.ndarray, favour: np.ndarray | None) -> np.ndarray:
        r = np.exp(-(2 * (1 - u @ centre.T)) / sigma)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        if favour is not None:
            r *= favour.T[own]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        return r

    def by_batch(r: np.ndarray, own: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.stack([r[own == b].T @ v[own == b] for b in range(len(names))])

    def summed(part, shape) -> np.ndarray:
        """Sum of ``part(z, code, out)`` over pieces of the points."""
        total = np.zeros(shape)
        if few:
            for s in range(0, n, 4096):
                total += part(z[s : s + 4096], codes[s : s + 4096], out[s : s + 4096])
            return total

        def run(batches):
            sums = np.zeros(shape)
            for t in batches:
                zs, own, outs = neighbors._matrix(t.column(1)), t.column(2).to_numpy(), neighbors._matrix(t.column(3))
                for s in range(0, len(zs), 4096):
                    sums += part(zs[s : s + 4096], own[s : s + 4096], outs[s : s + 4096])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["v"])

        for r in rows.mapInArrow(run, "v binary").collect():
            total += np.frombuffer(r["v"]).reshape(shape)
        return total

    ones = lambda v: np.ones((len(v), 1))
    for _ in range(rounds):
        for _ in range(5):
            was = centre
            seen = summed(lambda v, own, o: by_batch(weights(_unit(o), own, was, None), own, ones(v)), (len(names), k, 1))[:, :, 0].T
            favour = ((np.outer(seen.sum(1), share) + 1) / (seen + 1)) ** theta
            centre = _unit(summed(lambda v, own, o: weights(_unit(o), own, was, favour).T @ _unit(o), (k, width)))
        sums = summed(lambda v, own, o: by_batch(weights(_unit(o), own, was, favour), own, np.concatenate([ones(v), v], 1)), (len(names), k, 1 + width))
        shift = np.zeros((k, len(names), width))
        keep = np.diag([0.0] + [ridge] * len(names))
        for c in range(k):
            mass, right = sums[:, c, 0], sums[:, c, 1:]
            gram = np.block([[mass.sum(), mass], [mass[:, None], np.diag(mass)]])
            shift[c] = np.linalg.solve(gram + keep + 1e-9 * np.eye(len(keep)), np.concatenate([right.sum(0)[None], right]))[1:]

        def moved(v, own, o, was=was, favour=favour, shift=shift):
            r, new = weights(_unit(o), own, was, favour), v.copy()
            for b in range(len(names)):
                new[own == b] -= r[own == b] @ shift[:, b]
            return new

        if few:
            out = np.concatenate([moved(z[s : s + 4096], codes[s : s + 4096], out[s : s + 4096]) for s in range(0, n, 4096)])
            continue

        def again(batches, moved=moved):
            for t in batches:
                new = moved(neighbors._matrix(t.column(1)), t.column(2).to_numpy(), neighbors._matrix(t.column(3)))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.ListArray.from_arrays(np.arange(0, new.size + 1, width, dtype=np.int32), new.ravel())], ["cell_id", "vec", "code", "out"])

        old, rows = rows, rows.mapInArrow(again, f"cell_id {kind}, vec array<double>, code int, out array<double>").persist()
        rows.count()
        old.unpersist()
    return _table(points, ids, out) if few else rows.select("cell_id", F.col("out").alias("vec"))


def mutual_neighbours(points: DataFrame, k: int = 20, bandwidth: float = 15.0) -> DataFrame:
    """``(cell_id, vec)``: batches are added from the largest on, each shifted by the smoothed differences of its mutual neighbours.

    Neighbours, differences and their smoothing stay in Spark; ids must be
    integers.  Differences of one point are summed first, so that a point is
    smoothed over the points that have mutual neighbours, not over the pairs.
    """
    kind, width = dict(points.dtypes)["cell_id"], points.agg(F.max(F.size("vec"))).first()[0]
    norm = F.greatest(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)), F.lit(1e-12))
    unit = points.select(F.col("cell_id").cast("long"), F.transform("vec", lambda x: x / norm).alias("vec"), F.col("batch").cast("string").alias("batch")).persist()
    sizes = {r["batch"]: r["count"] for r in unit.groupBy("batch").count().collect()}
    done = None
    for name in sorted(sizes, key=lambda b: (-sizes[b], b)):
        new = unit.where(F.col("batch") == name).select("cell_id", "vec")
        if done is not None:
            new = _shifted(new, done, sizes[name], width, k, bandwidth).persist()
        done = new if done is None else done.unionByName(new)
    return done.select(F.col("cell_id").cast(kind), "vec")


def _shifted(new: DataFrame, done: DataFrame, size: int, width: int, k: int, bandwidth: float) -> DataFrame:
    there = neighbors.knn(new, k, True, done).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    back = neighbors.knn(done, k, True, new).select(F.col("dst").alias("i"), F.col("src").alias("j"))
    pairs = there.join(back, ["i", "j"]).join(done.select(F.col("cell_id").alias("j"), "vec"), "j")
    sums = pairs.groupBy("i").agg(F.count(F.lit(1)).cast("double").alias("m"), F.array(*[F.sum(F.col("vec")[t]) for t in range(width)]).alias("s"))
    gaps = new.join(sums, new["cell_id"] == sums["i"]).select(F.col("i").alias("key"), F.concat("vec", F.zip_with("s", "vec", lambda x, y: x - F.col("m") * y), F.array("m")).alias("vec"))
    sent = neighbors.sent_blocks(gaps)
    if not sent:
        return new

    def run(batches):
        for table, q in neighbors.gathered(batches):
            top, total, weight = np.full(len(q), -np.inf), np.zeros_like(q), np.zeros(len(q))
            for _, r in neighbors.each(sent):
                gap = r[:, width:]
                for s, t, d in neighbors.tiles(q, r[:, :width]):
                    e, at = -0.5 * bandwidth * np.maximum(d, 0), slice(s, s + len(d))
                    high = np.maximum(top[at], e.max(1))
                    e, fade = np.exp(e - high[:, None]), np.exp(top[at] - high)
                    got = e @ gap[t : t + d.shape[1]]
                    total[at] = total[at] * fade[:, None] + got[:, :-1]
                    weight[at] = weight[at] * fade + got[:, -1]
                    top[at] = high
            out = q + total / weight[:, None]
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.ListArray.from_arrays(np.arange(0, out.size + 1, width, dtype=np.int32), out.ravel())], ["cell_id", "vec"])

    return neighbors.dealt(new, size, width).mapInArrow(run, "cell_id bigint, vec array<double>")


def component_regression(points: DataFrame) -> DataFrame:
    """``(score)``: each component's R^2 on the batch's ordinal, weighted by its share of the variance; points are ``(cell_id, vec, batch)``."""
    code = F.dense_rank().over(Window.orderBy("batch")).cast("double")
    codes = points.select("batch").distinct().withColumn("code", code)
    e = points.join(F.broadcast(codes), "batch").select("code", F.posexplode("vec").alias("pc", "v"))
    per = e.groupBy("pc").agg(F.coalesce(F.regr_r2("v", "code"), F.lit(0.0)).alias("r2"), F.var_pop("v").alias("var"))
    return per.agg(F.coalesce(F.try_divide(F.sum(F.col("r2") * F.col("var")), F.sum("var")), F.lit(0.0)).alias("score"))


def batch_spread(points: DataFrame) -> float:
    """Mean squared distance between batch centroids, to see a correction's effect."""
    _, z, batch = _with_batches(points)
    c = np.stack([z[batch == b].mean(0) for b in np.unique(batch)])
    return float(_squared(c).mean())
