"""Runners that try several methods on one table and keep a row for each, failures with their reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.config import AnalysisConfig
from matrica.frame import CellFrame
from matrica.functions.ranks import hash_int, midrank
from matrica.operators import batch, classification, clustering, comparison, diagnostics, embeddings, feature_selection, neighbors, quality, resampling, tests_de, transforms


def _rows(spark, tries: dict[str, Callable[[], dict]], metrics: list[str]) -> DataFrame:
    """``(method, status, failure_reason, metrics...)`` of calls that give a dict of metrics."""
    out = []
    for name, run in tries.items():
        try:
            got = run()
            out.append((name, "ok", "", *[None if got.get(m) is None else float(got[m]) for m in metrics]))
        except MemoryError:
            raise
        except Exception as e:  # the row stays, with its reason
            out.append((name, "failed", f"{type(e).__name__}: {e}"[:300], *[None] * len(metrics)))
    return spark.createDataFrame(out, "method string, status string, failure_reason string, " + ", ".join(f"{m} double" for m in metrics))


def scored(results: DataFrame, weights: dict[str, float], scoring: str = "weighted") -> DataFrame:
    """Adds ``score`` (``weighted``: mean of the metrics present by weight; ``borda``: rank sum) or ``pareto`` front membership."""
    if scoring == "weighted":
        have = [F.when(F.col(m).isNotNull(), F.lit(float(w))).otherwise(0.0) for m, w in weights.items()]
        top = sum((F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in weights.items()), F.lit(0.0))
        return results.withColumn("score", F.try_divide(top, sum(have, F.lit(0.0))))
    ok = results.where("status = 'ok'")
    if scoring == "borda":
        return quality.borda(ok, list(weights))
    if scoring == "pareto":
        return quality.pareto(ok, list(weights))
    raise ValueError(f"unknown scoring: {scoring}")


# --- transformations ---------------------------------------------------------------------

TRANSFORM_WEIGHTS = {"knn_overlap": 0.35, "silhouette": 0.25, "shapiro": 0.05, "anderson": 0.05, "loading_preservation": 0.30}


def loading_preservation(a: DataFrame, b: DataFrame) -> float:
    """Mean size of the Spearman correlation of absolute loadings, component by component, over the genes both have."""
    long = lambda d, v: d.select("gene_id", F.posexplode(F.slice("loadings", 1, 10)).alias("pc", v)).withColumn(v, F.abs(v))
    j = long(a, "x").join(long(b, "y"), ["gene_id", "pc"])
    j = j.withColumn("rx", midrank("x", ["pc"])).withColumn("ry", midrank("y", ["pc"]))
    return j.groupBy("pc").agg(F.abs(F.corr("rx", "ry")).alias("r")).agg(F.avg("r")).first()[0]


def benchmark_transformations(frame: CellFrame, label_col: str | None = None, names: list[str] | None = None, n_comps: int = 20, k: int = 15, weights: dict[str, float] | None = None, scoring: str = "weighted") -> DataFrame:
    """Each transform's neighbour overlap with the raw components, silhouette of the labels, share of normal genes and kept loadings."""
    if label_col:
        frame.require_obs(label_col)
    raw, base = embeddings.run_pca(frame, n_comps)
    near = neighbors.knn(raw.obsm["X_pca"], k).cache()

    def one(name: str) -> dict:
        done = transforms.transform(frame, name)
        rep, got = embeddings.run_pca(done, n_comps)
        rep = rep.obsm["X_pca"]
        out = {"knn_overlap": neighbors.knn_overlap(near, neighbors.knn(rep, k), k).first()[0], "loading_preservation": loading_preservation(base["loadings"], got["loadings"])}
        if label_col:
            p = rep.join(frame.obs.select("cell_id", F.col(label_col).alias("cluster")), "cell_id")
            out["silhouette"] = (neighbors.silhouette(p).agg(F.avg("silhouette")).first()[0] + 1) / 2
        first = done.var.orderBy("gene_ord").limit(50).select("gene_id")
        normal = diagnostics.normality_per_gene(replace(done, x=done.x.join(F.broadcast(first), "gene_id", "left_semi"), var=first.join(done.var, "gene_id")))
        shares = normal.agg(F.avg((F.col("p_value") > 0.05).cast("double")).alias("s"), F.avg((F.col("a2") < F.col("critical")).cast("double")).alias("a")).first()
        return out | {"shapiro": shares["s"], "anderson": shares["a"]}

    names = names or sorted(transforms.REGISTRY)
    res = _rows(frame.x.sparkSession, {n: (lambda n=n: one(n)) for n in names}, list(TRANSFORM_WEIGHTS))
    return scored(res, weights or TRANSFORM_WEIGHTS, scoring)


# --- batch correction --------------------------------------------------------------------

BATCH_WEIGHTS = {"kbet": 0.2, "lisi": 0.2, "batch_asw": 0.2, "bio_conservation": 0.4}


def bio_conservation(points: DataFrame) -> float:
    """Mean silhouette of ``label`` over ``(cell_id, vec, label)``."""
    return neighbors.silhouette(points.select("cell_id", "vec", F.col("label").alias("cluster"))).agg(F.avg("silhouette")).first()[0]


def benchmark_batch(points: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]] | None = None, k: int = 15, scoring: str = "weighted") -> DataFrame:
    """Corrections of ``(cell_id, vec, batch, label)``, each scored in its own space."""
    methods = {"none": lambda p: p, "harmony": batch.harmony, "mutual_neighbours": batch.mutual_neighbours} if methods is None else methods
    if not methods:
        raise ValueError("no method to compare")
    meta = points.select("cell_id", "batch", "label")

    def one(run: Callable) -> dict:
        p = run(points).select("cell_id", "vec").join(meta, "cell_id").cache()
        edges, of = neighbors.knn(p.select("cell_id", "vec"), k, True), p.select("cell_id", "batch")
        asw = neighbors.silhouette(p.select("cell_id", "vec", F.col("batch").alias("cluster"))).agg(F.avg("silhouette")).first()[0]
        out = {"kbet": neighbors.kbet(edges, of, k).first()[0], "lisi": neighbors.lisi(edges, of).first()[0], "batch_asw": None if asw is None else -asw, "bio_conservation": bio_conservation(p)}
        p.unpersist()
        return out

    res = _rows(points.sparkSession, {n: (lambda r=r: one(r)) for n, r in methods.items()}, list(BATCH_WEIGHTS))
    return scored(res, BATCH_WEIGHTS, "weighted" if scoring == "single_metric" else {"rank_aggregate": "borda"}.get(scoring, scoring))


# --- genes -------------------------------------------------------------------------------


def reduced(frame: CellFrame, genes: list) -> CellFrame:
    """The frame with only the named genes, in the given order; names it lacks are left out, none left is an error."""
    spark = frame.x.sparkSession
    kind = dict(frame.var.dtypes)["gene_id"]
    order = spark.createDataFrame([(g, i) for i, g in enumerate(dict.fromkeys(genes))], f"gene_id {kind}, gene_ord int")
    var = frame.var.drop("gene_ord").join(F.broadcast(order), "gene_id")
    if not var.limit(1).count():
        raise ValueError("none of the genes is in the frame")
    keep = lambda x: x.join(F.broadcast(order.select("gene_id")), "gene_id", "left_semi")
    return replace(frame, x=keep(frame.x), var=var, layers={k: keep(v) for k, v in frame.layers.items()})


SELECTORS = ("mutual_information", "pca_loadings", "boruta", "mrmr")


def select_features(frame: CellFrame, label_col: str, method: str = "mutual_information", n: int = 50, seed: int = 42) -> DataFrame:
    """``(gene_id, score, selected)`` for every gene; the score is null where the method gives none; genes above their shuffled copies go first (score over 1)."""
    frame.require_obs(label_col)
    if method == "mutual_information":
        got = feature_selection.mutual_information(frame, label_col, n, seed)
    elif method == "mrmr":
        got = feature_selection.mrmr(frame, label_col, n)
    elif method == "boruta":
        got = feature_selection.shadow_features(frame, label_col, seed=seed)
        got = got.select("gene_id", F.when(F.col("kept"), 1 + F.col("score")).otherwise(F.col("score")).alias("score"))
    elif method == "pca_loadings":
        got = embeddings.top_loading_genes(embeddings.run_pca(frame, n)[1]["loadings"], n).select("gene_id", F.abs("w").alias("score"))
    else:
        raise ValueError(f"unknown method: {method}; have {SELECTORS}")
    top = got.groupBy("gene_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "gene_id"))
    top = top.withColumn("selected", place <= n)
    return frame.var.select("gene_id").join(F.broadcast(top), "gene_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def vectors(frame: CellFrame, label_col: str) -> DataFrame:
    """``(cell_id, vec, label)`` over the frame's genes, zeros filled in; genes must be few, cells need not be."""
    x = frame.x.join(F.broadcast(frame.var.select("gene_id", "gene_ord")), "gene_id")
    genes = [r[0] for r in frame.var.select("gene_ord").orderBy("gene_ord").collect()]
    at = {g: i for i, g in enumerate(genes)}
    if len(at) > 20_000:
        raise ValueError(f"{len(at)} genes; choose at most 20,000 for vectors")
    m = x.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_ord", "value"))).alias("m"))
    order = F.array(*[F.lit(g) for g in genes])
    d = frame.obs.select("cell_id", F.col(label_col).cast("string").alias("label")).join(m, "cell_id", "left")
    vec = F.transform(order, lambda g: F.coalesce(F.element_at(F.coalesce("m", F.create_map().cast("map<int,double>")), g), F.lit(0.0)))
    return d.select("cell_id", vec.alias("vec"), "label")


def validate_reduced(frame: CellFrame, genes: list, label_col: str, model: str = "QDA", seed: int = 42) -> DataFrame:
    """``(space, accuracy, f1)`` of a model on all genes and on the chosen ones, the same fifth held out."""
    out = None
    for name, f in (("full", frame), ("reduced", reduced(frame, genes))):
        d = classification.stratified_folds(vectors(f, label_col), "label", "cell_id", 5, seed)
        test = d.where("fold = 0")
        p = classification.predict(d.where("fold <> 0"), test, model, seed)
        row = classification.metrics(p.join(test.select("cell_id", F.col("label").alias("true")), "cell_id")).select(F.lit(name).alias("space"), "accuracy", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def benchmark_features(frame: CellFrame, label_col: str, methods: tuple[str, ...] = SELECTORS, n: int = 50, model: str = "LogisticRegression", seed: int = 42) -> DataFrame:
    """Selectors fitted on the training cells only, judged by a model on the held-out fifth."""
    split = classification.stratified_folds(frame.obs, label_col, "cell_id", 5, seed).cache()
    train = replace(frame, x=frame.x.join(split.where("fold <> 0").select("cell_id"), "cell_id", "left_semi"), obs=split.where("fold <> 0").drop("fold"))

    def one(m: str) -> dict:
        genes = [r[0] for r in select_features(train, label_col, m, n, seed).where("selected").orderBy("gene_id").collect()]
        d = vectors(reduced(frame, genes), label_col).join(split.select("cell_id", "fold"), "cell_id")
        test = d.where("fold = 0")
        p = classification.predict(d.where("fold <> 0"), test, model, seed)
        r = classification.metrics(p.join(test.select("cell_id", F.col("label").alias("true")), "cell_id")).first()
        return {"accuracy": r["accuracy"], "f1": r["f1"], "n_genes": len(genes)}

    return _rows(frame.x.sparkSession, {m: (lambda m=m: one(m)) for m in methods}, ["accuracy", "f1", "n_genes"])


def hvg_sensitivity(frame: CellFrame, label_col: str, tops: tuple[int, ...] = (500, 1000, 2000, 3000), resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``(n_top, ari, best, is_stable)``: variable genes, components, neighbours, communities; stable if the best is within 5 % of the median."""
    from matrica.operators.contingency import agreement

    rows, p = [], frame.n_genes()
    for n in sorted({min(t, p) for t in tops}):
        hv = feature_selection.highly_variable(frame, n_top=n).where("highly_variable")
        rep = embeddings.run_pca(reduced(frame, [r[0] for r in hv.select("gene_id").collect()]), 50)[0].obsm["X_pca"]
        got = clustering.communities(neighbors.knn(rep, 15), resolution, seed)
        rows.append((n, float(agreement(got.join(frame.obs.select("cell_id", label_col), "cell_id"), label_col, "cluster").first()["ari"])))
    best, mid = max(r[1] for r in rows), float(np.median([r[1] for r in rows]))
    stable = (best - mid) / (abs(mid) + 1e-10) < 0.05
    return frame.x.sparkSession.createDataFrame([(n, a, a == best, stable) for n, a in rows], "n_top int, ari double, best boolean, is_stable boolean")


# --- models ------------------------------------------------------------------------------


def stacking(train: DataFrame, test: DataFrame, bases: tuple[str, ...] = ("LogisticRegression", "RandomForest", "SVM"), folds: int = 5, seed: int = 42) -> DataFrame:
    """``(cell_id, pred, confidence)``: base models' votes out of fold are the features of a last logistic model."""
    d = classification.stratified_folds(train, "label", "cell_id", folds, seed).cache()
    names = [r[0] for r in train.select(F.col("label").cast("string")).distinct().orderBy("label").collect()]

    def votes(parts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        out = None
        for i, base in enumerate(bases):
            one = None
            for fit, at in parts:
                p = classification.predict(fit, at, base, seed).select("cell_id", F.array(*[(F.col("pred") == n).cast("double") for n in names]).alias(f"v{i}"))
                one = p if one is None else one.unionByName(p)
            out = one if out is None else out.join(one, "cell_id")
        return out.select("cell_id", F.concat(*[F.col(f"v{i}") for i in range(len(bases))]).alias("vec"))

    seen = votes([(d.where(F.col("fold") != k), d.where(F.col("fold") == k)) for k in range(folds)]).join(train.select("cell_id", "label"), "cell_id")
    return classification.predict(seen, votes([(train, test)]), "LogisticRegression", seed)


def permutation_importance(train: DataFrame, test: DataFrame, model: str = "RandomForest", repeats: int = 5, seed: int = 42) -> DataFrame:
    """``(feature, importance, sd)``: accuracy lost when one feature is shuffled.

    The model is fitted once: every shuffled copy of the test cells is one part of
    a single table that is scored in one pass.
    """
    p = test.select(F.size("vec")).first()[0]
    copies = test.sparkSession.range(p * repeats).select(F.col("id").alias("copy"), (F.col("id") % p).cast("int").alias("j"))
    d = test.select("cell_id", "vec", F.col("label").cast("string").alias("true")).join(F.broadcast(copies))
    own, other = Window.partitionBy("copy").orderBy("cell_id"), Window.partitionBy("copy").orderBy(hash_int(seed, F.col("copy"), F.col("cell_id")), "cell_id")
    d = d.withColumn("at", F.row_number().over(own))
    to = d.withColumn("at", F.row_number().over(other)).select("copy", "at", F.element_at("vec", F.col("j") + 1).alias("new"))
    d = d.join(to, ["copy", "at"]).withColumn("vec", F.transform("vec", lambda x, i: F.when(i == F.col("j"), F.col("new")).otherwise(x)))
    whole = test.select("cell_id", "vec", F.col("label").cast("string").alias("true"), F.lit(-1).cast("bigint").alias("copy"), F.lit(-1).alias("j"))
    d = d.select("cell_id", "vec", "true", "copy", "j").unionByName(whole)
    n = F.struct("copy", "cell_id")
    keyed = d.withColumn("key", F.xxhash64(n)).cache()
    got = classification.predict(train, keyed.select(F.col("key").alias("cell_id"), "vec"), model, seed)
    acc = got.join(keyed.select(F.col("key").alias("cell_id"), "copy", "j", "true"), "cell_id").groupBy("copy", "j").agg(F.avg((F.col("pred") == F.col("true")).cast("double")).alias("a"))
    base = acc.where("j = -1").select(F.col("a").alias("base"))
    return acc.where("j >= 0").join(F.broadcast(base)).groupBy(F.col("j").alias("feature")).agg(F.avg(F.col("base") - F.col("a")).alias("importance"), F.coalesce(F.stddev_samp(F.col("base") - F.col("a")), F.lit(0.0)).alias("sd"))


def benchmark_632plus(cells: DataFrame, models: tuple[str, ...] = ("LDA", "NaiveBayes"), b: int = 10, seed: int = 42) -> DataFrame:
    """``(method, ..., score, train, oob)``: .632+ accuracy; cells left out of a bag judge its model."""
    d = resampling.indexed(cells, "cell_id").cache()
    n = d.count()
    gamma = resampling.no_information_rate(cells, "label").first()["rate"]

    def accuracy(fit: DataFrame, at: DataFrame, m: str) -> float:
        p = classification.predict(fit, at, m, seed)
        return p.join(at.select("cell_id", F.col("label").cast("string").alias("true")), "cell_id").agg(F.avg((F.col("pred") == F.col("true")).cast("double"))).first()[0]

    def one(m: str) -> dict:
        rows = []
        for k in range(b):
            draws = d.select((hash_int(seed, F.lit(k), F.col("i")) % n).alias("i"))
            bag = d.join(draws, "i")
            out = d.join(draws.distinct(), "i", "left_anti")
            a, o = accuracy(bag, d, m), accuracy(bag, out, m)
            if o is not None:
                rows.append((resampling.dot632plus(a, o, gamma), a, o))
        s = np.mean(rows, axis=0)
        return {"score": s[0], "train": s[1], "oob": s[2]}

    return _rows(cells.sparkSession, {m: (lambda m=m: one(m)) for m in models}, ["score", "train", "oob"])


# --- expression --------------------------------------------------------------------------


def pseudobulk_by_type(frame: CellFrame, condition_col: str, sample_col: str, type_col: str, alpha: float = 0.05, pseudocount: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Tests of every cell type with the type as key, and ``(type, status, n_significant)``; a type that cannot be tested keeps its status row."""
    frame.require_obs(condition_col, sample_col, type_col)
    spark, out, status = frame.x.sparkSession, None, []
    for (kind,) in frame.obs.select(F.col(type_col).cast("string")).distinct().orderBy(type_col).collect():
        obs = frame.obs.where(F.col(type_col).cast("string") == kind)
        part = replace(frame, x=frame.x.join(obs.select("cell_id"), "cell_id", "left_semi"), obs=obs)
        try:
            got = tests_de.pseudobulk_de(part, condition_col, sample_col, pseudocount).withColumn("type", F.lit(kind))
            status.append((kind, "ok", got.where(F.col("p_adjusted") < alpha).count()))
            out = got if out is None else out.unionByName(got)
        except (ValueError, KeyError) as e:
            status.append((kind, f"{type(e).__name__}: {e}"[:300], None))
    return out, spark.createDataFrame(status, "type string, status string, n_significant bigint")


def benchmark_de(frame: CellFrame, condition_col: str, g1: str, g2: str, sample_col: str = "sample", alpha: float = 0.05) -> DataFrame:
    """Genes each test finds below ``alpha`` after correction."""
    found = lambda d: {"n_significant": d.where(F.col("p_adjusted") < alpha).count(), "n_genes": d.count()}
    return _rows(frame.x.sparkSession, {
        "wilcoxon": lambda: found(tests_de.wilcoxon_de(frame, condition_col, g1, g2)),
        "ttest": lambda: found(tests_de.ttest_de(frame, condition_col, g1, g2)),
        "pseudobulk": lambda: found(tests_de.pseudobulk_de(frame, condition_col, sample_col)),
    }, ["n_significant", "n_genes"])


def find_markers(frame: CellFrame, group_col: str, n_genes: int = 50, layer: str | None = None) -> DataFrame:
    return tests_de.rank_genes(frame, group_col, n_genes, layer)


def shared_genes(reference: CellFrame, query: CellFrame, least: int = 10) -> list:
    """Genes of both, in the reference's order; too few is an error."""
    got = [r[0] for r in reference.var.join(query.var.select("gene_id"), "gene_id", "left_semi").orderBy("gene_ord").select("gene_id").collect()]
    if len(got) < least:
        raise ValueError(f"{len(got)} shared genes; {least} at least")
    return got


# --- time --------------------------------------------------------------------------------


def estimate_time(points: DataFrame, config: AnalysisConfig | None = None, calibration: int = 500, seed: int = 42) -> DataFrame:
    """``(method, stage, seconds, text)``: each method timed on a subsample and scaled by its complexity and grid."""
    config = config or AnalysisConfig()
    n = points.count()
    small = comparison.subsample(points, min(max(calibration, 50), n), seed=seed).cache()
    m, d, k = small.count(), points.select(F.size("vec")).first()[0], points.select("label").distinct().count()
    runs = {
        "kmeans": ("cluster", "nkd", 1, lambda p: clustering.kmeans(p, k, seed=seed)[0]),
        "hierarchical": ("cluster", "n3", 4, lambda p: clustering.hierarchical(p, k)),
        "leiden": ("cluster", "ndlogn", len(config.resolutions), lambda p: clustering.communities(neighbors.knn(p, min(15, m - 1)), 1.0, seed)),
        "silhouette": ("cluster", "n2d", 1, lambda p: neighbors.silhouette(p.select("cell_id", "vec", F.col("label").alias("cluster")))),
    } | {c: ("classify", "nd2" if c in ("LDA", "QDA") else "nd", config.cv_folds, lambda p, c=c: classification.predict(p, p, c, seed)) for c in config.classifiers if c in classification.MODELS}
    rows = []
    for name, (stage, cost, grid, run) in runs.items():
        if stage == "cluster" and name != "silhouette" and name not in config.clustering_methods:
            continue
        try:
            sec = resampling.extrapolate(comparison.profile(lambda: run(small))["seconds"], cost, m, n, d, k, grid)
        except MemoryError:
            raise
        except Exception:  # unknown, and shown as such
            sec = float("nan")
        rows.append((name, stage, None if sec != sec else float(sec), comparison.format_time(sec)))
    return points.sparkSession.createDataFrame(rows, "method string, stage string, seconds double, text string")
