"""Pair tables, resolutions, trees and figures' tables against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrica.frame import CellFrame, from_long
from matrica.operators import clustering, comparison, density, plot_tables


def _frame(spark, rows):
    """Two blobs far apart, with stragglers."""
    return spark.createDataFrame(rows, "cell_id bigint, vec array<double>")


def _blobs(n=30, gap=20.0, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=3) + (gap if i % 2 else 0)).tolist()) for i in range(n)] + [(n, [300.0, 0.0, 0.0])]


def test_method_pairs_and_exact_permutation(spark):
    rnd = random.Random(3)
    truth = [(i, "x") for i in range(40)]
    preds = [(i, m, "x" if rnd.random() < p else "y") for i in range(40) for m, p in (("a", 0.9), ("b", 0.5), ("c", 0.9)) if (i, m) != (0, "c")]
    t = spark.createDataFrame(truth, "cell_id bigint, true string")
    p = spark.createDataFrame(preds, "cell_id bigint, method string, pred string")
    ok = {(i, m): v == "x" for i, m, v in preds}
    got = {(r["a"], r["b"]): r for r in comparison.method_pairs(p, t).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for a, b in got:
        both = [i for i in range(40) if (i, a) in ok and (i, b) in ok]
        x, y = sum(ok[i, a] > ok[i, b] for i in both), sum(ok[i, a] < ok[i, b] for i in both)
        assert (got[a, b]["n"], got[a, b]["only_a"], got[a, b]["only_b"]) == (len(both), x, y)
        m = x + y
        flips = sum(math.comb(m, k) for k in range(m + 1) if abs(2 * k - m) >= abs(x - y)) / 2**m
        row = comparison.compare_classifiers(p, t, "permutation").where((F.col("a") == a) & (F.col("b") == b)).first()
        assert row["p_value"] == pytest.approx(flips, abs=1e-9)
    boot = comparison.compare_classifiers(p, t, b=500).where("a = 'a' AND b = 'b'").first()
    assert boot["ci_low"] <= boot["diff"] <= boot["ci_high"]
    with pytest.raises(ValueError):
        comparison.compare_classifiers(p, t, "guess")


def test_nvi_and_stable_resolution(spark):
    rows = [(r, i, str(i % k)) for r, k in ((0.5, 2), (1.0, 2), (2.0, 5)) for i in range(20)]
    a = spark.createDataFrame(rows, "resolution double, cell_id bigint, cluster string")
    got = {r["resolution"]: r["nvi"] for r in comparison.nvi(a).collect()}
    assert got[0.5] == pytest.approx(0)
    # the labels i % 2 and i % 5 are independent over 20 cells
    assert got[1.0] == pytest.approx((math.log(2) + math.log(5)) / math.log(20))
    assert comparison.stable_resolution(a) == 0.5


def test_search_resolution_narrows():
    best, tried = comparison.search_resolution(lambda r: -abs(r - 1.3), [0.5, 1.0, 2.0], 6)
    assert abs(best - 1.3) < 0.05 and len(tried) <= 15
    with pytest.raises(ValueError):
        comparison.search_resolution(lambda r: r, [])


def test_bootstrap_agreement_point(spark):
    from matrica.operators.contingency import agreement

    d = spark.createDataFrame([(str(i % 3), str(i % 3 if i % 5 else 1)) for i in range(90)], "t string, p string")
    want = agreement(d, "t", "p").first()
    got = {r["metric"]: r for r in comparison.bootstrap_agreement(d, "t", "p", 200).collect()}
    for m in ("ari", "nmi"):
        assert got[m]["value"] == pytest.approx(want[m]) and got[m]["ci_low"] <= got[m]["ci_high"]


def test_hdbscan_finds_blobs_and_noise(spark):
    rows = _blobs()
    lab = {r["cell_id"]: r["cluster"] for r in density.hdbscan(_frame(spark, rows), 5).collect()}
    assert lab[30] == "-1"
    assert len({lab[i] for i in range(0, 30, 2)} - {"-1"}) == 1 and len({lab[i] for i in range(1, 30, 2)} - {"-1"}) == 1 and lab[0] != lab[1]
    assert set(density.hdbscan_labels(np.zeros((3, 2)), 5)) == {-1}
    best, table = density.hdbscan_grid(_frame(spark, rows), (5, 8), (1, 5))
    assert table.count() == 4 and best.count() == 31


def test_spanning_tree_weight_is_least():
    x = np.random.default_rng(5).normal(size=(7, 2))
    core = np.array([np.sort(np.sqrt(((x - r) ** 2).sum(1)))[2] for r in x])
    w = {(i, j): max(core[i], core[j], float(np.sqrt(((x[i] - x[j]) ** 2).sum()))) for i, j in itertools.combinations(range(7), 2)}
    least, group = 0.0, list(range(7))
    for (i, j), v in sorted(w.items(), key=lambda t: t[1]):
        if group[i] != group[j]:
            least += v
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    assert density._spanning_tree(x, core)[:, 2].sum() == pytest.approx(least)


def test_cophenetic_by_hand(spark):
    p = _frame(spark, [(0, [0.0]), (1, [1.0]), (2, [10.0])])
    got = {(r["a"], r["b"]): r["cophenetic"] for r in density.cophenetic_pairs(p).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 10.0, (1, 2): 10.0}
    assert density.cophenetic_correlation(p) > 0.99
    z = clustering.linkage(np.array([[0, 1, 10], [1, 0, 9], [10, 9, 0]], float))
    assert plot_tables.last_merges(spark, z, 1).first()["height"] == 10.0


def test_patients(spark):
    rows = [(f"p{i}", "t", f"g{g}", float((i % 2) * 10 + g + i / 10)) for i in range(6) for g in range(4)] + [("p0", "rare", "g0", 1.0)]
    got = density.patients_by_type(spark.createDataFrame(rows, "patient string, type string, gene_id string, value double"), 2).collect()
    by = {(r["type"], r["patient"]): r["cluster"] for r in got}
    assert {t for t, _ in by} == {"t"} and by["t", "p0"] == by["t", "p2"] != by["t", "p1"] == by["t", "p3"]
    sim = [(a, b, 1.0 if (a - b) % 2 == 0 else 0.0) for a, b in itertools.combinations(range(6), 2)]
    lab = {r["cell_id"]: r["cluster"] for r in density.patients_by_similarity(spark.createDataFrame(sim, "a bigint, b bigint, similarity double"), 2).collect()}
    assert lab[0] == lab[2] == lab[4] != lab[1] == lab[3]


def test_figures_tables_edges(spark):
    x = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (1, "b", 4.0)], "cell_id bigint, gene_id string, value double")
    f = from_long(x, spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "cell_id bigint, grp string"))
    q = {(r["gene_id"], r["group"]): (r["n"], r["low"], r["median"], r["high"]) for r in plot_tables.gene_quartiles(f, ["a", "b"], "grp").collect()}
    assert q == {("a", "u"): (2, 2.0, 2.0, 2.0), ("a", "v"): (1, 0.0, 0.0, 0.0), ("b", "u"): (2, 0.0, 2.0, 4.0), ("b", "v"): (1, 0.0, 0.0, 0.0)}
    with pytest.raises(KeyError):
        plot_tables.gene_quartiles(f, ["zz"], "grp")
    assert plot_tables.histograms(f).agg(F.sum("n")).first()[0] == 6
    e = CellFrame(f.x, f.obs, f.var, {"u": _frame(spark, [(1, [1.0, 2.0])])})
    with pytest.raises(KeyError):
        plot_tables.compare_bases(e, ["nope"], "grp")
    assert plot_tables.compare_bases(e, ["u"], "grp").first()["c2"] == 2.0
    with pytest.raises(Exception, match="fewer than 3"):
        plot_tables.scatter(e.obsm["u"], f.obs, None, 3).collect()


def test_report_and_sweep(spark):
    a = spark.createDataFrame([("m1", 0.5), ("m2", 0.7)], "method string, ari double")
    b = spark.createDataFrame([("m1", 0.9)], "method string, f1 double")
    r = comparison.report({"cluster": a, "classify": b})
    assert r.count() == 3 and r.where("stage = 'classify'").first()["ari"] is None
    assert comparison.leaderboard(r.where("stage = 'cluster'")).where("place = 1").first()["method"] == "m2"
    got = comparison.scalability(lambda d: d.groupBy().count(), _frame(spark, _blobs()), (0.01, 1.0)).collect()
    assert [g["n"] for g in got] == [2, 31] and all(g["status"] == "ok" for g in got)
    assert comparison.format_time(float("nan")) == "unavailable" and comparison.format_time(90) == "1.5 min"
