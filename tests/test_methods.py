"""Layouts, batch correction, diagnostics, feature choice and settings on planted structure."""

import math

import numpy as np
import pytest

from matrica.config import AnalysisConfig
from matrica.frame import from_long
from matrica.functions.normality import anderson, shapiro
from matrica.operators import batch, diagnostics, layouts
from matrica.operators import feature_selection as fs


def blobs(spark, n=30, shift=0.0, seed=1):
    """Two clusters, each seen in two batches that differ by ``shift``."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(2 * n):
        b = i % 2
        centre = np.array([6.0 * (i >= n), 1.0, 0.5]) + shift * b * np.array([0, 1.0, 1.0])
        rows.append((i, (centre + rng.normal(0, 0.3, 3)).tolist(), f"b{b}", f"c{int(i >= n)}"))
    return spark.createDataFrame(rows, "cell_id long, vec array<double>, batch string, label string")


def test_shapiro_and_anderson():
    w, p = shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))  # published example
    assert abs(w - 0.7888) < 5e-4 and abs(p - 0.0067) < 3e-4
    rng = np.random.default_rng(0)
    assert shapiro(rng.normal(size=200))[1] > 0.05 > shapiro(rng.exponential(size=200))[1]
    a, c = anderson(rng.exponential(size=200))
    assert a > c and (lambda r: r[0] < r[1])(anderson(rng.normal(size=200)))
    assert math.isnan(shapiro(np.ones(9))[0]) and math.isnan(shapiro(np.array([1.0, 2.0]))[0])


def test_layouts_keep_neighbours(spark):
    p = blobs(spark)
    for name in ("umap", "tsne", "diffusion_map"):
        got = {r["cell_id"]: r["vec"] for r in getattr(layouts, name)(p).collect()}
        assert len(got) == 60 and np.isfinite(list(got.values())).all(), name
    t = {r["method"]: r for r in layouts.benchmark_embeddings(p, ("umap", "tsne", "nothing")).collect()}
    assert t["umap"]["trustworthiness"] > 0.7 and t["tsne"]["trustworthiness"] > 0.7 and t["nothing"]["status"] == "unknown"
    assert layouts.force_directed(p).count() == 60
    with pytest.raises(ValueError):
        layouts._points(p, 10)


def test_spectral_clusters(spark):
    p = blobs(spark)
    got = {r["cell_id"]: r["cluster"] for r in layouts.spectral_clustering(p, 2).collect()}
    assert len({got[i] for i in range(30)}) == len({got[i] for i in range(30, 60)}) == 1 and got[0] != got[59]


def test_batches_come_together(spark):
    p = blobs(spark, shift=2.0)
    before = batch.batch_spread(p)
    side = p.select("cell_id", "batch")
    assert batch.batch_spread(batch.harmony(p).join(side, "cell_id")) < before / 4
    unit = p.selectExpr("cell_id", "transform(vec, x -> x / sqrt(aggregate(vec, 0D, (a, v) -> a + v * v))) AS vec", "batch")
    assert batch.batch_spread(batch.mutual_neighbours(p, k=5).join(side, "cell_id")) < batch.batch_spread(unit)
    score = lambda d: batch.component_regression(d).first()["score"]
    assert score(p) > score(batch.harmony(p).join(side, "cell_id"))


def counts(spark, n=80):
    """g0 follows the label, g1 the batch, the rest neither; g9 is all zero."""
    rng = np.random.default_rng(3)
    x, obs = [], []
    for i in range(n):
        lab, b = i % 2, (i // 2) % 2
        obs.append((i, f"l{lab}", f"b{b}"))
        for g in range(6):
            x.append((i, f"g{g}", float(rng.poisson(2 + 8 * (g == 0) * lab + 5 * (g == 1) * b))))
    var = spark.createDataFrame([(f"g{g}",) for g in (0, 1, 2, 3, 4, 5, 9)], "gene_id string")
    return from_long(spark.createDataFrame(x, "cell_id long, gene_id string, value double"), spark.createDataFrame(obs, "cell_id long, label string, batch string"), var)


def test_combat_moves_batch_means(spark):
    f = batch.combat(counts(spark), "batch")
    d = f.layers["combat"].where("gene_id = 'g1'").join(f.obs, "cell_id").groupBy("batch").avg("value").collect()
    assert abs(d[0][1] - d[1][1]) < 1.0
    assert f.layers["combat"].where("isnan(value)").count() == 0 and f.layers["combat"].where("gene_id = 'g9' AND value <> 0").count() == 0


def test_feature_choice(spark):
    f = counts(spark)
    assert fs.mutual_information(f, "label", 3).orderBy("rank").first()["gene_id"] == "g0"
    got = fs.mrmr(f, "label", 3).orderBy("rank").collect()
    assert got[0]["gene_id"] == "g0" and len(got) == 3
    assert {r["gene_id"] for r in fs.shadow_features(f, "label", trees=30).where("kept").collect()} >= {"g0"}
    for m in ("seurat_v3", "cell_ranger", "pearson_residuals"):
        h = fs.highly_variable(f, m, 2)
        assert h.count() == 7 and h.where("highly_variable").count() == 2
    with pytest.raises(ValueError):
        fs.highly_variable(f, "other")


def test_neighbour_information():
    rng = np.random.default_rng(0)
    y = np.repeat(["a", "b"], 200)
    assert fs.neighbour_information(rng.normal(size=400) + 9 * (y == "a"), y) > 0.6 > 0.1 > fs.neighbour_information(rng.normal(size=400), y)
    assert fs.neighbour_information(np.array([1.0]), np.array(["a"])) == 0


def test_box_m_and_normality(spark):
    rng = np.random.default_rng(4)
    same = [(i, rng.normal(size=3).tolist(), "ab"[i % 2]) for i in range(400)]
    other = [(i, (rng.normal(size=3) * (1 + 4 * (i % 2))).tolist(), "ab"[i % 2]) for i in range(400)]
    table = lambda rows: spark.createDataFrame(rows, "cell_id long, vec array<double>, grp string")
    assert diagnostics.box_m(table(same))["recommendation"] == "LDA" and diagnostics.box_m(table(other))["p_value"] < 1e-6
    assert math.isnan(diagnostics.box_m(table(same[:4]))["m"])
    r = diagnostics.check_normality(counts(spark)).first()
    assert r["n_genes"] == 7 and 0 <= r["shapiro_pass"] < 1


def test_config_round_trip(tmp_path):
    c = AnalysisConfig.preset("robust")
    c.save(f"{tmp_path}/d/c.json")
    assert AnalysisConfig.load(f"{tmp_path}/d/c.json") == c and AnalysisConfig.preset("fast").cv_folds == 3
    with pytest.raises(ValueError):
        AnalysisConfig.preset("none")
