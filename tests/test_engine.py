import math
import os

import numpy as np
import pytest

from matrica.frame import from_long, from_wide
from matrica.functions import tails
from matrica.functions.ranks import adjust_pvalues
from matrica.operators import clustering, embeddings, quality, resampling, tests_de, transforms

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (30, 6))
    x[:, 5] = 0
    rows = [(i, f"g{j}", float(x[i, j])) for i in range(30) for j in range(6)]
    obs = spark.createDataFrame([(i, "a" if i < 12 else "b") for i in range(30)], "cell_id long, grp string")
    var = spark.createDataFrame([(f"g{j}", j) for j in range(6)], "gene_id string, gene_ord int")
    return x, from_long(spark.createDataFrame(rows, "cell_id long, gene_id string, value double"), obs, var)


def test_tails_against_known_values():
    assert math.isclose(float(tails.chi2_sf(5.991464547107979, 2)), 0.05, rel_tol=1e-9)
    assert math.isclose(float(tails.t_sf2(2.228138852, 10)), 0.05, rel_tol=1e-6)
    assert math.isclose(float(tails.f_sf(4.964602744, 1, 10)), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.hypergeom_sf(3, 20, 5, 6), sum(math.comb(5, k) * math.comb(15, 6 - k) for k in range(3, 6)) / math.comb(20, 6), rel_tol=1e-12)
    assert math.isclose(tails.mwu_exact_sf2(0, 3, 3), 2 / math.comb(6, 3), rel_tol=1e-9)


def test_benjamini_hochberg_anchor(spark):
    p = spark.createDataFrame([(i, v) for i, v in enumerate((0.01, 0.02, 0.03, 0.04, 0.05))] + [(9, None)], "i int, p_value double")
    got = {r["i"]: r["p_adjusted"] for r in adjust_pvalues(p, tie="i").collect()}
    assert all(math.isclose(got[i], 0.05) for i in range(5)) and got[9] is None


def test_rank_sum_with_zero_completion(small):
    x, f = small
    r, _ = tests_de.rank_sums(f, "grp")
    got = {(a["gene_id"], a["grp"]): a["rank_sum"] for a in r.collect()}
    for j in range(6):
        v = x[:, j]
        mid = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert math.isclose(got[f"g{j}", "a"], mid[:12].sum()) and math.isclose(got[f"g{j}", "b"], mid[12:].sum())


def test_all_zero_gene_has_p_one(small):
    _, f = small
    got = {r["gene_id"]: r["p_value"] for r in tests_de.wilcoxon_de(f, "grp", "a", "b").collect()}
    assert got["g5"] == 1.0
    with pytest.raises(ValueError):
        tests_de.wilcoxon_de(f, "grp", "a", "missing")
    with pytest.raises(KeyError):
        tests_de.wilcoxon_de(f, "nothing", "a", "b")


def test_pca_matches_numpy(small):
    x, f = small
    _, got = embeddings.run_pca(f, 3)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(got["variance"], s[:3] ** 2 / 29)


def test_transforms_registered(small):
    _, f = small
    with pytest.raises(KeyError):
        transforms.transform(f, "nothing")
    assert transforms.transform(f, "log_cpm", out_layer="l").layers["l"].count() == f.x.count()


def test_composite_missing_metric_stays_in_its_arm(spark):
    m = spark.createDataFrame([("a", 0.1, 0.5, None), ("b", 0.4, 0.7, 1.0), ("c", 0.2, 0.9, 2.0)], "label string, top1_confusion double, pred_agreement double, pred_entropy double")
    got = {r["label"]: r["s"] for r in quality.composite(m, {"top1_confusion": 1, "pred_agreement": 2, "pred_entropy": 0}, "s").collect()}
    assert math.isclose(got["a"], (1 + 0) / 3) and math.isclose(got["b"], (0 + 1) / 3)
    bad = {r["label"]: r["s"] for r in quality.composite(m, {"top1_confusion": 1, "pred_entropy": 2}, "s").collect()}
    assert bad["a"] is None and bad["b"] is not None


def test_borda_all_tied(spark):
    m = spark.createDataFrame([("m1", 0.9, 0.5), ("m2", 0.8, 0.6), ("m3", 0.7, 0.9)], "method string, a double, b double")
    assert {r["borda_score"] for r in quality.borda(m, ["a", "b"]).collect()} == {4.0}


def test_linkage_and_cut():
    p = np.array([0.0, 0.1, 5.0, 5.2])
    assert list(clustering.cut(clustering.linkage(np.abs(p[:, None] - p)), 2)) == [0, 0, 1, 1]


def test_communities_find_two_cliques(spark):
    e = [(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a != b] + [(0, 4)]
    got = {r["cell_id"]: r["cluster"] for r in clustering.communities(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[0] != got[5]


def test_icc_of_identical_values(spark):
    assert resampling.icc(spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "target int, value double")).first()[0] == 1.0


def test_from_wide_splits_columns(spark):
    f = from_wide(spark.createDataFrame([("c1", 1.0, 0.0, "x", 3)], "id string, g1 double, g2 double, kind string, y int"), "id", "y")
    assert f.x.count() == 1 and set(f.obs.columns) == {"cell_id", "kind", "y"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
