"""Label quality: how recoverable each category of a label column is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.ranks import min_rank, quality_rank

SUPERVISED = ("pred_agreement", "pred_entropy", "pred_avg_confidence")
INVERTED = ("confusion", "fragmentation", "entropy")
#: Frozen logistic fusions: intercept, rank of the composite, rank of the silhouette, their product.
FUSIONS = {
    "fusion_add": (2.469469952903643, -1.8297248915285826, -4.958684167833358, 0.0),
    "fusion_log": (2.9277555346275688, -2.806706408259526, -6.399737857821906, 2.9943287500623796),
}
VARIANTS = ["composite", "composite_frag", "composite_silhouette", "composite_frag_silhouette", "fusion_add", "fusion_log", "unsup_only", "sup_only", "unsup_frag_only", "confusion_top1", "confusion_mean", "fragmentation_mean", "pred_agreement", "pred_entropy", "pred_avg_confidence", "silhouette"]


def consensus(predictions: DataFrame) -> DataFrame:
    """``(cell_id, pred_consensus, pred_agreement, pred_entropy, pred_avg_confidence)``
    of ``(cell_id, model, pred, confidence)``; consensus ties go to the first
    label in order; models without probabilities do not count in confidence."""
    c = predictions.groupBy("cell_id", "pred").agg(F.count(F.lit(1)).alias("v"))
    w = Window.partitionBy("cell_id")
    p = F.col("v") / F.sum("v").over(w)
    c = c.withColumn("p", p).withColumn("r", F.row_number().over(w.orderBy(F.desc("v"), "pred")))
    votes = c.groupBy("cell_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("pred"))).alias("pred_consensus"), F.max("p").alias("pred_agreement"), (-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("pred_entropy")
    )
    conf = predictions.groupBy("cell_id").agg(F.avg("confidence").alias("pred_avg_confidence"))
    return votes.join(conf, "cell_id")


def label_means(cells: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric per label; NaN counts as missing."""
    clean = [F.avg(F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))).alias(m) for m in metrics]
    return cells.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(*clean)


def composite(means: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """Adds the weighted mean of min-max scaled metrics (a constant metric
    scales to 0); confusion, fragmentation and entropy count inverted.  A
    metric of weight 0 is left out before its missing values can spread; an
    active one that is missing for a label makes that label's score missing."""
    total = sum(weights.values())
    over = Window.partitionBy(F.lit(0))
    parts: Column = F.lit(0.0)
    for m, w in weights.items():
        if not w:
            continue
        lo, hi = F.min(m).over(over), F.max(m).over(over)
        u = F.when(F.col(m).isNull(), None).when(hi == lo, 0.0).otherwise(F.try_divide(F.col(m) - lo, hi - lo))
        g = 1 - u if any(k in m for k in INVERTED) else u
        parts = parts + g * F.lit(float(w))
    return means.withColumn(out, parts / total if total else F.lit(None).cast("double"))


def _weights(conf: list[str], frag: list[str], sup: list[str], s: float, u: float, f: float) -> dict[str, float]:
    return {c: u for c in conf} | {c: f for c in frag} | {c: s for c in sup}


def quality_score(means: DataFrame, conf: list[str], frag: list[str], sup: list[str] = SUPERVISED, supervised_weight: float = 2.0, unsupervised_weight: float = 1.0, fragmentation_weight: float = 1.0) -> DataFrame:
    """``(label, score)`` ascending: the worst label first."""
    got = composite(means, _weights(conf, frag, list(sup), supervised_weight, unsupervised_weight, fragmentation_weight), "score")
    return got.select("label", "score").orderBy(F.asc_nulls_last("score"), "label")


def variants(means: DataFrame, conf: list[str], frag: list[str], sup: list[str] = SUPERVISED, silhouette: str = "silhouette", fusions: dict | None = None) -> DataFrame:
    """The 16 scores per label; ``means`` has the metrics' label means and the silhouette."""
    sup = list(sup)
    missing = [c for c in [*conf, *frag, *sup, silhouette] if c not in means.columns]
    if missing or not conf or not frag:
        raise ValueError(f"missing columns: {missing or 'confusion or fragmentation'}")
    d = means
    for name, w in (
        ("composite", _weights(conf, frag, sup, 2, 1, 0)),
        ("composite_frag", _weights(conf, frag, sup, 2, 1, 1)),
        ("unsup_only", _weights(conf, frag, sup, 0, 1, 0)),
        ("sup_only", _weights(conf, frag, sup, 2, 0, 0)),
        ("unsup_frag_only", _weights(conf, frag, sup, 0, 1, 1)),
    ):
        d = composite(d, w, f"_{name}")
    mean = lambda cols: sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)
    d = d.withColumn("_r", quality_rank("_composite")).withColumn("_rf", quality_rank("_composite_frag")).withColumn("_g", quality_rank(silhouette))
    fused = {k: -(F.lit(a) + b * F.col("_r") + c * F.col("_g") + e * F.col("_r") * F.col("_g")) for k, (a, b, c, e) in (fusions or FUSIONS).items()}
    got = {
        **{k: F.col(f"_{k}") for k in ("composite", "composite_frag", "unsup_only", "sup_only", "unsup_frag_only")},
        "composite_silhouette": F.round((F.col("_r") + F.col("_g")) / 2, 12),
        "composite_frag_silhouette": F.round((F.col("_rf") + F.col("_g")) / 2, 12),
        **fused,
        "confusion_top1": -F.col(conf[0]),
        "confusion_mean": -mean(conf),
        "fragmentation_mean": -mean(frag),
        "pred_agreement": F.col(sup[0]),
        "pred_entropy": -F.col(sup[1]),
        "pred_avg_confidence": F.col(sup[2]),
        "silhouette": F.col(silhouette),
    }
    return d.select("label", *[got[v].alias(v) for v in VARIANTS])


def review_ranks(scores: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Min-rank of every score, ascending: 1 is reviewed first; missing stays missing."""
    cols = cols or [c for c in scores.columns if c != "label"]
    return scores.select("label", *[min_rank(c).cast("long").alias(c) for c in cols])


def borda(results: DataFrame, metrics: list[str], method: str = "method", lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Sum of average ranks over metrics and the final min-rank, 1 the best."""
    from matrica.functions.ranks import midrank

    ranks = [midrank(F.col(m) if m in lower_is_better else -F.col(m)) for m in metrics]
    d = results.select(method, *[r.alias(f"_{i}") for i, r in enumerate(ranks)])
    d = d.withColumn("borda_score", sum((F.col(f"_{i}") for i in range(len(metrics))), F.lit(0.0)))
    return d.select(method, "borda_score", F.rank().over(Window.partitionBy(F.lit(0)).orderBy("borda_score")).alias("borda_rank"))


def pareto(results: DataFrame, metrics: list[str], method: str = "method") -> DataFrame:
    """Methods that no other beats in one metric while being as good in all."""
    a, b = results.alias("a"), results.alias("b")
    ge = [F.col(f"b.{m}") >= F.col(f"a.{m}") for m in metrics]
    gt = [F.col(f"b.{m}") > F.col(f"a.{m}") for m in metrics]
    cond = ge[0]
    for c in ge[1:]:
        cond = cond & c
    some = gt[0]
    for c in gt[1:]:
        some = some | c
    return a.join(b, cond & some, "left_anti").select(f"a.{method}", *[f"a.{m}" for m in metrics])
