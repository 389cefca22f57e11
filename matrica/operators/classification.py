"""Classification metrics from grouped counts, and pyspark.ml model panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.ranks import hash_int, midrank


def metrics(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """One row: accuracy, macro precision, recall, F1, fdr, fnr, MCC, kappa, balanced accuracy."""
    c = df.groupBy(F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_class = (
        c.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("t"), F.lit(0.0).alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0).alias("c")), F.struct(F.col("p").alias("k"), F.lit(0.0).alias("t"), F.col("n").alias("p"), F.lit(0.0).alias("c")))).alias("e"))
        .groupBy("e.k")
        .agg(F.sum("e.t").alias("t"), F.sum("e.p").alias("p"), F.sum("e.c").alias("c"))
    )
    prec, rec = F.coalesce(F.try_divide("c", "p"), F.lit(0.0)), F.coalesce(F.try_divide("c", "t"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("c"), F.col("t") + F.col("p")), F.lit(0.0))
    a = by_class.agg(F.sum("c").alias("c"), F.sum("t").alias("s"), F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.avg(prec).alias("precision"), F.avg(rec).alias("recall"), F.avg(f1).alias("f1"), F.avg(F.when(F.col("t") > 0, rec)).alias("balanced_accuracy"))
    s = F.col("s")
    mcc = F.coalesce(F.try_divide(F.col("c") * s - F.col("pt"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))), F.lit(0.0))
    pe = F.col("pt") / (s * s)
    return a.select((F.col("c") / s).alias("accuracy"), "precision", "recall", "f1", (1 - F.col("precision")).alias("fdr"), (1 - F.col("recall")).alias("fnr"), mcc.alias("mcc"), F.try_divide(F.col("c") / s - pe, 1 - pe).alias("kappa"), "balanced_accuracy")


def auroc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """``(auroc, average_precision)`` of a boolean column and a score."""
    c = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    up, down = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("rank", F.coalesce(F.sum("n").over(up), F.lit(0)) + (F.col("n") + 1) / 2).withColumn("tp", F.sum("p").over(down)).withColumn("seen", F.sum("n").over(down))
    tot = c.agg(F.sum("p").alias("pos"), F.sum("n").alias("all"), F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("ap"))
    return tot.select(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("all") - F.col("pos"))).alias("auroc"), F.try_divide("ap", "pos").alias("average_precision"))


def auroc_ovr(df: DataFrame, true: str, scores: dict[str, str]) -> DataFrame:
    """``(class, auroc, average_precision)`` one against the rest; the macro value is their mean."""
    out = None
    for name, col in scores.items():
        d = auroc(df.withColumn("_y", F.col(true).cast("string") == F.lit(name)), "_y", col).withColumn("class", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def mcnemar_counts(df: DataFrame, true: str, a: str, b: str) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic; none gives 0."""
    ra, rb = F.col(a) == F.col(true), F.col(b) == F.col(true)
    c = df.agg(F.sum((ra & ~rb).cast("long")).alias("b"), F.sum((~ra & rb).cast("long")).alias("c"))
    d = F.abs(F.col("b") - F.col("c")) - 1
    return c.select("b", "c", F.when(F.col("b") + F.col("c") == 0, 0.0).otherwise(F.try_divide((d * d).cast("double"), F.col("b") + F.col("c"))).alias("statistic"))


def mcnemar(df: DataFrame, true: str, a: str, b: str) -> dict:
    from matrica.functions.tails import binom_two_sided, chi2_sf

    r = mcnemar_counts(df, true, a, b).first()
    n = (r["b"] or 0) + (r["c"] or 0)
    p = 1.0 if not n else binom_two_sided(r["b"], n) if n < 25 else float(chi2_sf(r["statistic"], 1))
    return {"b": r["b"], "c": r["c"], "statistic": r["statistic"], "p_value": p}


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: labels dealt in turn, in hash order; the same in any SQL engine."""
    w = Window.partitionBy(label).orderBy(hash_int(seed, F.col(key)), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def _ml(name: str, seed: int, n: int, k: int, p: int):
    from pyspark.ml import classification as C

    lin = dict(featuresCol="features", labelCol="y")
    if name == "LogisticRegression":
        return C.LogisticRegression(family="multinomial", regParam=1.0 / max(n, 1), standardization=False, maxIter=100, **lin)
    if name == "RandomForest":
        return C.RandomForestClassifier(numTrees=100, maxDepth=12, seed=seed, **lin)
    if name == "SVM":
        return C.OneVsRest(classifier=C.LinearSVC(maxIter=100), **lin)
    if name == "MLP":
        return C.MultilayerPerceptronClassifier(layers=[p, 100, 50, k], seed=seed, maxIter=100, **lin)
    if name == "NaiveBayes":
        return C.NaiveBayes(modelType="gaussian", **lin)
    if name == "GradientBoosting":
        return C.OneVsRest(classifier=C.GBTClassifier(seed=seed, maxIter=30), **lin)
    raise ValueError(f"unknown model: {name}")


MODELS = ["LogisticRegression", "RandomForest", "SVM", "MLP", "NaiveBayes", "GradientBoosting", "KNN", "LDA", "QDA"]


def _discriminant(train: DataFrame, test: DataFrame, quadratic: bool) -> DataFrame:
    """Gaussian classes: means and covariances are summed per class in Spark,
    solved on the driver (features by features), scored by Arrow batches."""
    import numpy as np
    import pandas as pd

    rows = train.select("y", "vec")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["vec"].tolist(), float)
        return pd.DataFrame({"y": [pdf["y"].iloc[0]], "n": [len(m)], "s": [m.sum(0).tolist()], "g": [(m.T @ m).ravel().tolist()]})

    salted = rows.withColumn("lot", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    parts = salted.groupBy("y", "lot").applyInPandas(add, "y double, n bigint, s array<double>, g array<double>").collect()
    acc: dict[float, list] = {}
    for r in parts:
        a = acc.setdefault(r["y"], [0, 0.0, 0.0])
        a[0] += r["n"]
        a[1] = a[1] + np.array(r["s"])
        a[2] = a[2] + np.array(r["g"])
    ys = sorted(acc)
    total = sum(acc[y][0] for y in ys)
    mean = [acc[y][1] / acc[y][0] for y in ys]
    p = len(mean[0])
    within = [acc[y][2].reshape(p, p) - acc[y][0] * np.outer(m, m) for y, m in zip(ys, mean)]
    cov = [0.99 * w / max(acc[y][0] - 1, 1) + 0.01 * np.eye(p) for y, w in zip(ys, within)] if quadratic else [sum(within) / max(total - len(ys), 1) + 1e-9 * np.eye(p)] * len(ys)
    inv = [np.linalg.pinv(c) for c in cov]
    base = [np.log(acc[y][0] / total) - 0.5 * np.linalg.slogdet(c)[1] for y, c in zip(ys, cov)]

    def score(batches):
        for pdf in batches:
            m = np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1)
            f = np.stack([b - 0.5 * np.einsum("ij,jk,ik->i", m - mu, i, m - mu) for b, mu, i in zip(base, mean, inv)], 1)
            e = np.exp(f - f.max(1, keepdims=True))
            pr = e / e.sum(1, keepdims=True)
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "prediction": np.array(ys)[pr.argmax(1)], "confidence": pr.max(1)})

    return test.select("cell_id", "vec").mapInPandas(score, "cell_id bigint, prediction double, confidence double")


def predict(train: DataFrame, test: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """``(cell_id, pred, confidence)`` on ``test`` of a model fitted on ``train``; both ``(cell_id, vec, label)``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names = [r[0] for r in train.select(F.col("label").cast("string")).distinct().orderBy("label").collect()]
    arr = F.array(*[F.lit(x) for x in names])
    tr = train.withColumn("y", (F.array_position(arr, F.col("label").cast("string")) - 1).cast("double")).withColumn("features", array_to_vector("vec"))
    te = test.withColumn("features", array_to_vector("vec"))
    back = lambda c: F.element_at(arr, F.col(c).cast("int") + 1)
    if name == "KNN":
        from matrica.operators.neighbors import knn, vote

        e = knn(test.select("cell_id", "vec"), 5, include_self=True, reference=train.select("cell_id", "vec"))
        return vote(e, train.select("cell_id", F.col("label").cast("string").alias("label"))).select(F.col("src").alias("cell_id"), "pred", "confidence")
    if name in ("LDA", "QDA"):
        return _discriminant(tr, te, name == "QDA").select("cell_id", back("prediction").alias("pred"), "confidence")
    p = tr.select(F.size("vec")).first()[0]
    got = _ml(name, seed, tr.count(), len(names), p).fit(tr).transform(te)
    conf = F.array_max(vector_to_array("probability")) if "probability" in got.columns and name not in ("SVM", "GradientBoosting") else F.lit(None).cast("double")
    return got.select("cell_id", back("prediction").alias("pred"), conf.alias("confidence"))


def benchmark_models(cells: DataFrame, models: list[str] | None = None, folds: int = 5, seed: int = 42, fit: Callable = predict) -> DataFrame:
    """``(model, fold, status, failure_reason, accuracy, f1, ...)`` rows of a stratified cross-validation; a model that fails keeps its row and reason."""
    d = stratified_folds(cells, "label", "cell_id", folds, seed).cache()
    spark = cells.sparkSession
    out = None
    for name in models or MODELS:
        for k in range(folds):
            try:
                test = d.where(F.col("fold") == k)
                p = fit(d.where(F.col("fold") != k), test, name, seed)
                row = metrics(p.join(test.select("cell_id", F.col("label").alias("true")), "cell_id"))
                row = spark.createDataFrame(row.collect(), row.schema).select(F.lit(name).alias("model"), F.lit(k).alias("fold"), F.lit("ok").alias("status"), F.lit("").alias("failure_reason"), "*")
            except MemoryError:
                raise
            except Exception as e:  # the row stays, with its reason
                row = spark.createDataFrame([(name, k, "failed", f"{type(e).__name__}: {e}"[:300])], "model string, fold int, status string, failure_reason string")
            out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def pooled_auc_rank(df: DataFrame, score: str) -> DataFrame:
    """The scores with their midranks, for inspection."""
    return df.withColumn("rank", midrank(score))
