"""Two-group and many-group tests per gene, set tests and effect sizes.

Ranks and moments are taken over the stored non-zeros; the zeros of a gene are
one tied block whose rank follows from counts, so no dense grid is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrica.frame import CellFrame
from matrica.functions.ranks import adjust_pvalues
from matrica.functions.tails import chi2_sf_col, f_sf_col, hypergeom_sf, norm_sf2_col, t_sf2_col


def _groups(frame: CellFrame, group_col: str, only: list | None = None) -> DataFrame:
    frame.require_obs(group_col)
    obs = frame.obs.select("cell_id", F.col(group_col).cast("string").alias("grp")).where(F.col("grp").isNotNull())
    if only:
        obs = obs.where(F.col("grp").isin([str(g) for g in only]))
        have = {r[0] for r in obs.select("grp").distinct().collect()}
        gone = [g for g in only if str(g) not in have]
        if gone:
            raise ValueError(f"no cells in group {gone}")
    return obs


def rank_sums(frame: CellFrame, group_col: str, only: list | None = None, layer: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """``(gene_id, grp, rank_sum, ties)`` with zero completion, and group sizes.

    ``ties`` is the sum of t^3 - t over the gene's tied blocks.
    """
    obs = _groups(frame, group_col, only)
    sizes = {r["grp"]: r["count"] for r in obs.groupBy("grp").count().collect()}
    n = sum(sizes.values())
    v = frame.matrix(layer).where("value <> 0").join(F.broadcast(obs) if n < 200_000 else obs, "cell_id")
    # Count by (gene, value, group) first: repeated values meet before any window sees them.
    c = v.groupBy("gene_id", "value", "grp").agg(F.count(F.lit(1)).alias("m"))
    g = Window.partitionBy("gene_id")
    t = F.sum("m").over(Window.partitionBy("gene_id", "value"))
    c = c.withColumn("t", t).withColumn("nnz", F.sum("m").over(g))
    below = F.coalesce(F.sum("m").over(g.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.col("t")
    c = c.withColumn("below", below).withColumn("zeros", F.lit(n) - F.col("nnz"))
    c = c.withColumn("rank", F.col("below") + (F.col("t") + 1) / 2 + F.when(F.col("value") > 0, F.col("zeros")).otherwise(0))
    first = F.row_number().over(Window.partitionBy("gene_id", "value").orderBy("grp")) == 1
    neg = F.sum(F.when(F.col("value") < 0, F.col("m")).otherwise(0)).over(g)
    c = c.withColumn("tie", F.when(first, F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).otherwise(0.0)).withColumn("neg", neg)
    ties = F.sum("tie").over(g) + F.pow(F.col("zeros").cast("double"), F.lit(3.0)) - F.col("zeros")
    c = c.withColumn("ties", ties).withColumn("zrank", F.col("neg") + (F.col("zeros") + 1) / 2)
    per = c.groupBy("gene_id", "grp").agg(F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").alias("m"))
    head = c.groupBy("gene_id").agg(F.max("ties").alias("ties"), F.max("zrank").alias("zrank"))
    names = F.array(*[F.struct(F.lit(k).alias("grp"), F.lit(s).cast("long").alias("size")) for k, s in sorted(sizes.items())])
    allg = frame.var.select("gene_id").join(head, "gene_id", "left").select("gene_id", F.coalesce("ties", F.lit(float(n) ** 3 - n)).alias("ties"), F.coalesce("zrank", F.lit((n + 1) / 2)).alias("zrank"), F.explode(names).alias("g"))
    full = allg.select("gene_id", "ties", "zrank", "g.grp", "g.size").join(per, ["gene_id", "grp"], "left")
    total = F.coalesce("r", F.lit(0.0)) + (F.col("size") - F.coalesce("m", F.lit(0))) * F.col("zrank")
    return full.select("gene_id", "grp", "size", total.alias("rank_sum"), "ties"), sizes


def moments(frame: CellFrame, group_col: str, only: list | None = None, layer: str | None = None) -> DataFrame:
    """``(gene_id, grp, n, mean, var)``: sample variance over all cells of the group."""
    obs = _groups(frame, group_col, only)
    size = obs.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    s = frame.matrix(layer).join(obs, "cell_id").groupBy("gene_id", "grp").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    grid = frame.var.select("gene_id").join(F.broadcast(size)).join(s, ["gene_id", "grp"], "left").na.fill(0.0, ["s1", "s2"])
    var = F.try_divide(F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")), F.col("n") - 1)
    return grid.select("gene_id", "grp", "n", (F.col("s1") / F.col("n")).alias("mean"), var.alias("var"))


def _two(m: DataFrame, g1: str, g2: str, cols: list[str]) -> DataFrame:
    pick = lambda g, c: F.max(F.when(F.col("grp") == str(g), F.col(c)))
    return m.groupBy("gene_id").agg(*[pick(g, c).alias(f"{c}{i}") for i, g in ((1, g1), (2, g2)) for c in cols])


def log2fc(m1: Column, m2: Column, pseudocount: float) -> Column:
    return F.log2((m1 + pseudocount) / (m2 + pseudocount))


def mann_whitney(frame: CellFrame, group_col: str, g1, g2, layer: str | None = None) -> DataFrame:
    """``(gene_id, n1, n2, u, z)``: U of the first group, z with continuity and tie correction."""
    r, _ = rank_sums(frame, group_col, [g1, g2], layer)
    d = _two(r, g1, g2, ["rank_sum", "size", "ties"])
    n1, n2 = F.col("size1").cast("double"), F.col("size2").cast("double")
    n = n1 + n2
    u = F.col("rank_sum1") - n1 * (n1 + 1) / 2
    s2 = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties1"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), F.sqrt(F.greatest(s2, F.lit(0.0))))
    return d.select("gene_id", F.col("size1").alias("n1"), F.col("size2").alias("n2"), u.alias("u"), z.alias("z"))


def wilcoxon_de(frame: CellFrame, group_col: str, g1, g2, correction: str = "fdr_bh", pseudocount: float = 0.01, layer: str | None = None) -> DataFrame:
    u = mann_whitney(frame, group_col, g1, g2, layer)
    m = _two(moments(frame, group_col, [g1, g2], layer), g1, g2, ["mean"])
    d = u.join(m, "gene_id").withColumn("p_value", F.coalesce(norm_sf2_col(F.col("z")), F.lit(1.0)))
    d = d.withColumn("log2fc", log2fc(F.col("mean1"), F.col("mean2"), pseudocount)).withColumn("rank_biserial", 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1)
    d = d.withColumn("cliffs_delta", F.col("rank_biserial"))
    return adjust_pvalues(d, "p_value", correction, tie="gene_id")


def effect_sizes(frame: CellFrame, group_col: str, g1, g2, layer: str | None = None) -> DataFrame:
    """``(gene_id, cohens_d, hedges_g)`` with the pooled deviation plus 1e-10."""
    d = _two(moments(frame, group_col, [g1, g2], layer), g1, g2, ["n", "mean", "var"])
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.coalesce("var1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("var2", F.lit(0.0)), df))
    c = (F.col("mean1") - F.col("mean2")) / (pooled + 1e-10)
    return d.select("gene_id", c.alias("cohens_d"), (c * (1 - 3 / (4 * df - 1))).alias("hedges_g"))


def welch(frame: CellFrame, group_col: str, g1, g2, layer: str | None = None) -> DataFrame:
    """``(gene_id, t, df, mean1, mean2)``; undefined t is null."""
    d = _two(moments(frame, group_col, [g1, g2], layer), g1, g2, ["n", "mean", "var"])
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1))
    return d.select("gene_id", t.alias("t"), df.alias("df"), "mean1", "mean2")


def ttest_de(frame: CellFrame, group_col: str, g1, g2, correction: str = "fdr_bh", pseudocount: float = 0.01, layer: str | None = None) -> DataFrame:
    d = welch(frame, group_col, g1, g2, layer).join(effect_sizes(frame, group_col, g1, g2, layer), "gene_id")
    d = d.withColumn("p_value", F.coalesce(t_sf2_col(F.col("t"), F.col("df")), F.lit(1.0))).withColumn("t", F.coalesce("t", F.lit(0.0)))
    d = d.withColumn("log2fc", log2fc(F.col("mean1"), F.col("mean2"), pseudocount))
    return adjust_pvalues(d, "p_value", correction, tie="gene_id")


def permutation_de(frame: CellFrame, group_col: str, g1, g2, n_permutations: int = 1000, correction: str = "fdr_bh", pseudocount: float = 0.01, seed: int = 42, layer: str | None = None) -> DataFrame:
    """Permuted absolute mean differences; p = (count + 1) / (B + 1).

    A permutation orders the cells by a hash of (seed, replicate, cell) and
    takes the first n1 as the first group.
    """
    from matrica.functions.ranks import hash_int

    obs = _groups(frame, group_col, [g1, g2])
    m = _two(moments(frame, group_col, [g1, g2], layer), g1, g2, ["n", "mean"]).withColumn("diff", F.col("mean1") - F.col("mean2"))
    n1, n2 = (obs.where(F.col("grp") == str(g)).count() for g in (g1, g2))
    reps = obs.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("b"))
    place = F.row_number().over(Window.partitionBy("b").orderBy(hash_int(seed, F.col("b"), F.col("cell_id")), "cell_id"))
    first = reps.withColumn("i", place).where(F.col("i") <= n1).select("cell_id", "b")
    v = frame.matrix(layer).join(obs, "cell_id").select("cell_id", "gene_id", "value")
    total = v.groupBy("gene_id").agg(F.sum("value").alias("total"))
    s = v.join(first, "cell_id").groupBy("gene_id", "b").agg(F.sum("value").alias("s"))
    d = s.join(total, "gene_id").join(m.select("gene_id", "diff"), "gene_id")
    hit = (F.abs(F.col("s") / n1 - (F.col("total") - F.col("s")) / n2) >= F.abs("diff") - 1e-12).cast("long")
    seen = d.groupBy("gene_id").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("k"))
    # Replicates in which the first group has no count of a gene.
    none = m.join(total, "gene_id", "left").join(seen, "gene_id", "left").na.fill(0, ["hits", "k", "total"])
    empty = (F.lit(n_permutations) - F.col("k")) * (F.abs(F.col("total") / n2) >= F.abs("diff") - 1e-12).cast("long")
    out = none.select("gene_id", "diff", log2fc(F.col("mean1"), F.col("mean2"), pseudocount).alias("log2fc"), ((F.col("hits") + empty + 1) / (n_permutations + 1)).alias("p_value"))
    return adjust_pvalues(out, "p_value", correction, tie="gene_id")


def pseudobulk_de(frame: CellFrame, condition_col: str, sample_col: str, pseudocount: float = 0.01, layer: str | None = None) -> DataFrame:
    """Sums per sample, then Mann-Whitney between the two conditions in order; two samples each at least."""
    from dataclasses import replace

    frame.require_obs(condition_col, sample_col)
    obs = frame.obs.select("cell_id", F.concat_ws("|", F.col(condition_col), F.col(sample_col)).alias("s"), F.col(condition_col).cast("string").alias("cond"))
    groups = [r["cond"] for r in obs.select("s", "cond").distinct().groupBy("cond").count().where("count >= 2").orderBy("cond").collect()]
    if len(groups) != 2:
        raise ValueError(f"two conditions with two samples each are needed, have {groups}")
    x = frame.matrix(layer).join(obs, "cell_id").groupBy(F.col("s").alias("cell_id"), "gene_id").agg(F.sum("value").alias("value"))
    bulk = replace(frame, x=x, obs=obs.select(F.col("s").alias("cell_id"), F.col("cond").alias(condition_col)).distinct(), layers={}, obsm={})
    return wilcoxon_de(bulk, condition_col, groups[0], groups[1], pseudocount=pseudocount)


def anova(frame: CellFrame, group_col: str, layer: str | None = None, correction: str = "bonferroni") -> DataFrame:
    """``(gene_id, f, df1, df2, p_value, p_adjusted)``."""
    m = moments(frame, group_col, None, layer)
    s = m.groupBy("gene_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"))
    between = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    d = s.select("gene_id", f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))
    return adjust_pvalues(d.withColumn("p_value", F.coalesce(f_sf_col(F.col("f"), F.col("df1"), F.col("df2")), F.lit(1.0))), "p_value", correction, tie="gene_id")


def kruskal(frame: CellFrame, group_col: str, layer: str | None = None, correction: str = "fdr_bh") -> DataFrame:
    """``(gene_id, h, p_value, p_adjusted)`` with tie correction."""
    r, sizes = rank_sums(frame, group_col, None, layer)
    n = float(sum(sizes.values()))
    s = r.groupBy("gene_id").agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size")).alias("q"), F.max("ties").alias("ties"))
    h = F.try_divide(F.lit(12 / (n * (n + 1))) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n**3 - n))
    d = s.select("gene_id", h.alias("h"))
    return adjust_pvalues(d.withColumn("p_value", F.coalesce(chi2_sf_col(F.col("h"), F.lit(len(sizes) - 1)), F.lit(1.0))), "p_value", correction, tie="gene_id")


def dunn(frame: CellFrame, gene, group_col: str, layer: str | None = None) -> DataFrame:
    """``(a, b, z, p_value, p_adjusted)`` of one gene's groups, Holm-adjusted."""
    from dataclasses import replace

    one = replace(frame, var=frame.var.where(F.col("gene_id") == F.lit(gene)), x=frame.matrix(layer).where(F.col("gene_id") == F.lit(gene)))
    r, sizes = rank_sums(one, group_col)
    n = float(sum(sizes.values()))
    mean = r.select("grp", "size", (F.col("rank_sum") / F.col("size")).alias("m"), "ties")
    a, b = mean.alias("a"), mean.alias("b")
    d = a.join(b, F.col("a.grp") < F.col("b.grp"))
    s = F.sqrt((n * (n + 1) / 12 - F.col("a.ties") / (12 * (n - 1))) * (1 / F.col("a.size") + 1 / F.col("b.size")))
    d = d.select(F.col("a.grp").alias("a"), F.col("b.grp").alias("b"), F.try_divide(F.col("a.m") - F.col("b.m"), s).alias("z"))
    return adjust_pvalues(d.withColumn("p_value", F.coalesce(norm_sf2_col(F.col("z")), F.lit(1.0))), "p_value", "holm", tie="a")


def ora_counts(query: DataFrame, background: DataFrame, sets: DataFrame) -> DataFrame:
    """``(set, a, b, c, d)`` of the 2 x 2 tables: in query and set, in query only, in set only, in neither."""
    bg = background.select("gene").distinct()
    q = query.select("gene").distinct().join(bg, "gene", "left_semi").withColumn("q", F.lit(1))
    n = bg.count()
    nq = q.count()
    s = sets.select("set", "gene").distinct().join(bg, "gene", "left_semi").join(q, "gene", "left")
    c = s.groupBy("set").agg(F.count(F.lit(1)).alias("m"), F.sum(F.coalesce("q", F.lit(0))).cast("long").alias("a"))
    return c.select("set", "a", (F.lit(nq) - F.col("a")).cast("long").alias("b"), (F.col("m") - F.col("a")).alias("c"), (F.lit(n) - F.lit(nq) - F.col("m") + F.col("a")).cast("long").alias("d"))


def over_representation(query: DataFrame, background: DataFrame, sets: DataFrame) -> DataFrame:
    """Fisher one-sided per set with odds ratio, BH-adjusted, smallest p first."""
    c = ora_counts(query, background, sets)
    tail = F.udf(lambda a, b, c_, d: hypergeom_sf(a, a + b + c_ + d, a + c_, a + b), "double")
    o = F.when(F.col("b") * F.col("c") == 0, F.lit(float("inf"))).otherwise(F.try_divide((F.col("a") * F.col("d")).cast("double"), F.col("b") * F.col("c")))
    d = c.withColumn("odds_ratio", o).withColumn("p_value", tail("a", "b", "c", "d"))
    return adjust_pvalues(d, "p_value", "fdr_bh", tie="set").orderBy("p_value", "set")


def marker_scores(frame: CellFrame, markers: DataFrame, method: str = "threshold", threshold: float = 0.1, layer: str | None = None) -> DataFrame:
    """``(cell_id, type, score)``: share of a type's markers above the threshold, or their mean.

    ``markers``: ``(type, type_ord, gene_id)``; markers not in the matrix are ignored.
    """
    known = markers.join(frame.var.select("gene_id"), "gene_id", "left_semi").select("type", "type_ord", "gene_id").distinct()
    size = known.groupBy("type", "type_ord").agg(F.count(F.lit(1)).alias("m"))
    value = (F.col("value") > threshold).cast("double") if method == "threshold" else F.col("value")
    s = frame.matrix(layer).join(F.broadcast(known), "gene_id").groupBy("cell_id", "type").agg(F.sum(value).alias("s"))
    grid = frame.obs.select("cell_id").join(F.broadcast(size))
    return grid.join(s, ["cell_id", "type"], "left").select("cell_id", "type", "type_ord", (F.coalesce("s", F.lit(0.0)) / F.col("m")).alias("score"))


def annotate(frame: CellFrame, markers: DataFrame, **kw) -> DataFrame:
    """``(cell_id, predicted, score)``: best type, ties to the first in order."""
    s = marker_scores(frame, markers, **kw)
    r = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("score"), "type_ord"))
    return s.withColumn("r", r).where("r = 1").select("cell_id", F.col("type").alias("predicted"), "score")


def rank_genes(frame: CellFrame, group_col: str, n_genes: int = 50, layer: str | None = None) -> DataFrame:
    """One against the rest for every group: ``(group, gene_id, z, rank)``, largest z first.

    All groups share one ranking of each gene; the rest is total minus group.
    """
    r, sizes = rank_sums(frame, group_col, None, layer)
    n = float(sum(sizes.values()))
    n1 = F.col("size").cast("double")
    s2 = n1 * (n - n1) / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = F.coalesce(F.try_divide(F.col("rank_sum") - n1 * (n + 1) / 2, F.sqrt(F.greatest(s2, F.lit(0.0)))), F.lit(0.0))
    d = r.select(F.col("grp").alias("group"), "gene_id", z.alias("z"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("z"), "gene_id"))
    return d.withColumn("rank", place).where(F.col("rank") <= n_genes)
