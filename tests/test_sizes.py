"""What must not grow with the number of rows, and results that blocks and tiles must not change."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrica.operators import neighbors


@pytest.fixture
def tiny(monkeypatch):
    """Blocks and tiles so small that few points fill many."""
    monkeypatch.setattr(neighbors, "ROWS", 7)
    monkeypatch.setattr(neighbors, "TILE", 11)
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 500)


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def cloud(n, d=3, seed=0, copies=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[:copies] = x[0]
    return x


def brute(x, y, k, same):
    d = ((x[:, None] - y[None]) ** 2).sum(2)
    if same:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


def table(spark, x, **more):
    cols = list(more)
    return spark.createDataFrame([(i, v.tolist(), *[more[c][i] for c in cols]) for i, v in enumerate(x)], ", ".join(["cell_id bigint", "vec array<double>", *[f"{c} string" for c in cols]]))


def test_nearest_in_tiles_with_ties(tiny):
    x = cloud(90, copies=30)
    ids = np.arange(90)
    blocks = [(ids[a : a + 25], x[a : a + 25]) for a in range(0, 90, 25)]
    for same in (True, False):
        who, d = neighbors.nearest(ids, x, iter(blocks), 8, same)
        want, dist = brute(x, x, 8, same)
        assert (who == want).all() and np.allclose(d, dist)
    who, d = neighbors.nearest(ids, x, iter(blocks), 100, True)
    assert np.isfinite(d).sum(1).max() == 89


def test_nearest_memory_does_not_follow_the_reference():
    ids, r = np.arange(300_000), cloud(300_000, 4)
    assert peak_mb(lambda: neighbors.nearest(np.arange(512), r[:512], iter([(ids, r)]), 5, True)) < 60


def test_knn_in_blocks(spark, tiny):
    x = cloud(60, copies=9)
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbors.knn(table(spark, x), 5).collect()}
    want, _ = brute(x, x, 5, True)
    assert got == {(i, c + 1): want[i, c] for i in range(60) for c in range(5)}


def test_silhouette_in_blocks(spark, tiny):
    x, lab = cloud(50, copies=4), [str(i % 4) for i in range(49)] + ["alone"]
    got = {r["cell_id"]: r["silhouette"] for r in neighbors.silhouette(table(spark, x, cluster=lab)).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(50):
        own = [j for j in range(50) if lab[j] == lab[i] and j != i]
        b = min(d[i, [j for j in range(50) if lab[j] == c]].mean() for c in set(lab) - {lab[i]})
        want = 0.0 if not own else (b - d[i, own].mean()) / max(b, d[i, own].mean())
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_trustworthiness_by_ranks(spark, tiny):
    x, k = cloud(40, 4, copies=5), 6
    low, high = x[:, :2], brute(x, x, 39, True)[0]
    place = {(i, int(j)): c + 1 for i in range(40) for c, j in enumerate(high[i])}
    want = 1 - 2 / (40 * k * (80 - 3 * k - 1)) * sum(max(place[i, int(j)] - k, 0) for i in range(40) for j in brute(low, low, k, True)[0][i])
    seen, knn = [], neighbors.knn
    neighbors.knn = lambda p, k, *a, **b: (seen.append(k), knn(p, k, *a, **b))[1]
    try:
        assert neighbors.trustworthiness(table(spark, x), table(spark, low), k) == pytest.approx(want)
    finally:
        neighbors.knn = knn
    assert max(seen) == k  # no table of all pairs


def test_mutual_neighbours_by_hand_and_driver_memory(spark):
    from matrica.operators import batch

    n, k, width = 2400, 10, 15.0
    x = cloud(n, 6)
    got = {}
    run = lambda: got.update({r["cell_id"]: r["vec"] for r in batch.mutual_neighbours(table(spark, x, batch=["a" if i % 5 < 3 else "b" for i in range(n)]), k, width).collect()})
    assert peak_mb(run) < 40
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    one, two = np.flatnonzero(np.arange(n) % 5 < 3), np.flatnonzero(np.arange(n) % 5 >= 3)
    there, back = brute(u[two], u[one], k, False)[0], brute(u[one], u[two], k, False)[0]
    pairs = [(i, j) for i in range(len(two)) for j in there[i] if i in back[j]]
    i, j = np.array(pairs).T
    for c in range(0, len(two), 97):
        w = np.exp(-0.5 * width * ((u[two[c]] - u[two[i]]) ** 2).sum(1))
        assert np.allclose(got[two[c]], u[two[c]] + (w[:, None] * (u[one[j]] - u[two[i]])).sum(0) / w.sum(), atol=1e-9)
    assert np.allclose(got[one[5]], u[one[5]])


def test_harmony_on_driver_and_in_spark(spark, monkeypatch):
    from matrica.operators import batch

    monkeypatch.setattr(batch, "MAX_CELLS", 100)
    p = table(spark, cloud(150), batch=["ab"[i % 2] for i in range(150)])
    few = {r["cell_id"]: r["vec"] for r in batch.harmony(p, rounds=2).collect()}
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 1000)
    many = {r["cell_id"]: r["vec"] for r in batch.harmony(p, rounds=2).collect()}
    assert all(np.allclose(few[i], many[i], atol=1e-9) for i in range(150))


@pytest.mark.parametrize("name", ["diffusion_map", "spectral_clustering", "tsne", "umap", "force_directed"])
def test_layouts_above_the_square_matrix(spark, monkeypatch, name):
    """The form for many points gives what the square matrices give."""
    from matrica.operators import layouts

    x = cloud(150, 4)
    x[75:, 0] += 8 * (name == "spectral_clustering")
    p = table(spark, x)
    more = {"spectral_clustering": {"k": 2}, "tsne": {"rounds": 6}, "umap": {"rounds": 2}, "force_directed": {"rounds": 4}}.get(name, {"n_comps": 5})
    run = lambda: {r["cell_id"]: r[1] for r in getattr(layouts, name)(p, **more).collect()}
    few = run()
    monkeypatch.setattr(layouts, "MAX_POINTS", 50)
    many = run()
    assert len(few) == len(many) == 150
    if name == "spectral_clustering":
        assert all((few[i] == few[0]) == (many[i] == many[0]) for i in range(150))
    else:
        a, b = (np.array([v[i] for i in range(150)]) for v in (few, many))
        assert np.abs(a - b).max() <= 1e-6 * np.abs(a).max()


def test_fragmentation_has_no_window(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), (None, "x"), ("b", None)], "label string, cluster string")
    got = neighbors.fragmentation(d)
    assert sorted((r["label"] or "", r["cluster"] or "", round(r["fragmentation"], 6)) for r in got.collect()) == [("", "x", 0.0), ("a", "x", 0.333333), ("a", "x", 0.333333), ("a", "y", 0.666667), ("b", "", 0.0)]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_box_cox_fits_values_not_cells(spark, monkeypatch):
    from matrica.frame import from_long
    from matrica.operators import transforms

    v = np.random.default_rng(2).poisson(1.5, 400).astype(float)
    f = from_long(spark.createDataFrame([(i, "g", x) for i, x in enumerate(v.tolist())], "cell_id bigint, gene_id string, value double"), spark.range(400).withColumnRenamed("id", "cell_id"), spark.createDataFrame([("g",)], "gene_id string"))
    got = transforms.transform(f, "box_cox").x
    lam = transforms.boxcox_lambda(v + 1)
    y = {r["cell_id"]: r["value"] for r in got.collect()}
    assert np.allclose([y[i] for i in range(400)], np.expm1(lam * np.log(v + 1)) / lam, atol=1e-5)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_co_occurrence_counts_no_pairs(spark):
    from matrica.operators import clustering

    rows = [(i, f"r{m}", "-1" if i % 7 == 0 and m == 3 else str(i % m)) for i in range(30) for m in (2, 3, 5)]
    got = clustering.co_occurrence(spark.createDataFrame(rows, "cell_id bigint, run string, cluster string"))
    at = {(i, r): c for i, r, c in rows if c != "-1"}
    want = {(a, b): n / 3 for a in range(30) for b in range(a + 1, 30) if (n := sum((a, r) in at and at.get((a, r)) == at.get((b, r)) for r in ("r2", "r3", "r5")))}
    assert {(r["a"], r["b"]): pytest.approx(r["share"]) for r in got.collect()} == want
    after = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in after  # nothing is grouped once pairs are made


def test_components_are_not_exploded(spark):
    from matrica.frame import from_long
    from matrica.operators import embeddings

    x = np.random.default_rng(3).poisson(1.0, (40, 5)).astype(float)
    f = from_long(spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(5)], "cell_id bigint, gene_id string, value double"), spark.range(41).withColumnRenamed("id", "cell_id"))
    frame, got = embeddings.run_pca(f, 3)
    rep = frame.obsm["X_pca"]
    full = np.vstack([x, np.zeros(5)])
    load = np.array([r["loadings"] for r in got["loadings"].orderBy("gene_id").collect()])
    vec = {r["cell_id"]: r["vec"] for r in rep.collect()}
    assert np.allclose([vec[i] for i in range(41)], (full - full.mean(0)) @ load)
    assert "Generate" not in rep._jdf.queryExecution().optimizedPlan().toString()
