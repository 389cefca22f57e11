"""Registered queries of the engine over the supplied tables, and the SQL that says the same.

Cells are customers, genes are part brands, counts are line items; the label
is the market segment, the batch the region, the sample the nation, the
condition the sign of the balance.  Embeddings are a second set of points.
Computed doubles are rounded on both sides.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matrica.frame import CellFrame, from_long
from matrica.functions import ranks
from matrica.operators import batch, classification, clustering, comparison, contingency, density, diagnostics, embeddings, feature_selection, layouts, neighbors, plot_tables, quality, resampling, summary, tests_de, transforms
from matrica.plans import benchmarks

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _twice_rounded(sql: str) -> str:
    """``round(x, 6)`` as ``round(round(x, 12), 6)``, as ``rounded`` does."""
    out, opened = [], []
    for piece in re.split(r"(\bround\(|\(|\))", sql):
        if piece in ("round(", "("):
            opened.append(len(out) if piece == "round(" else None)
        elif piece == ")" and opened:
            at = opened.pop()
            if at is not None and out[-1].endswith(", 6"):
                out[at], out[-1] = "round(round(", out[-1][:-3] + ", 12), 6"
        out.append(piece)
    return "".join(out)


def query(name: str, sql: str | None = None):
    def add(fn):
        _Q[name] = fn
        if sql:
            _SQL[name] = _twice_rounded(sql)
        return fn

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def frame(spark: SparkSession, d: str) -> CellFrame:
    """The customer by brand count matrix with its metadata."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = t(spark, d, "part").select("p_partkey", "p_brand")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    x = x.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    c, n, r = t(spark, d, "customer"), t(spark, d, "nation"), t(spark, d, "region")
    obs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    obs = obs.select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("label"), F.col("r_name").alias("batch"), F.col("n_name").alias("sample"), F.when(F.col("c_acctbal") >= 0, "pos").otherwise("neg").alias("condition"))
    return from_long(x, obs, p.select(F.col("p_brand").alias("gene_id")).distinct())


def points(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("string").alias("label"), (F.col("vec_id") % 7).cast("string").alias("cluster"), (F.col("vec_id") % 3).cast("string").alias("batch"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, to 12 digits first, so that sums in another order do not fall to the other side of a half; -0 becomes 0."""
    return df.select(*[(F.round(F.round(F.col(c), 12), digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_M = """WITH x AS (SELECT o_custkey AS cell_id, p_brand AS gene_id, count(*)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS label, r_name AS batch, n_name AS sample, CASE WHEN c_acctbal >= 0 THEN 'pos' ELSE 'neg' END AS condition FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
var AS (SELECT DISTINCT p_brand AS gene_id FROM part), nc AS (SELECT count(*)::DOUBLE AS n FROM obs),
tot AS (SELECT cell_id, CASE WHEN sum(value) = 0 THEN 1 ELSE sum(value) END AS t FROM x GROUP BY 1),
grid AS (SELECT obs.cell_id, var.gene_id, coalesce(x.value, 0) AS value FROM obs CROSS JOIN var LEFT JOIN x ON x.cell_id = obs.cell_id AND x.gene_id = var.gene_id)"""
_E = """WITH e AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS vec, label::VARCHAR AS label, (vec_id % 7)::VARCHAR AS cluster, (vec_id % 3)::VARCHAR AS batch FROM embeddings),
dist AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.vec, b.vec) AS dd FROM e a CROSS JOIN e b),
nn AS (SELECT src, dst, dd, row_number() OVER (PARTITION BY src ORDER BY dd, dst) AS r FROM dist WHERE src <> dst),
nns AS (SELECT src, dst, dd, row_number() OVER (PARTITION BY src ORDER BY dd, dst) AS r FROM dist)"""


# --- summaries -----------------------------------------------------------------


@query("dataset_summary", _M + " SELECT count(*)::BIGINT AS n_cells, (SELECT count(*) FROM var)::BIGINT AS n_genes, round((SELECT sum(value) FROM x), 6) AS total, round((SELECT sum(value) FROM x) / count(*), 6) AS mean_per_cell, round(1 - (SELECT count(*) FROM x WHERE value <> 0)::DOUBLE / (count(*) * (SELECT count(*) FROM var)), 6) AS sparsity FROM obs")
def _(s, d):
    return rounded(summary.dataset_summary(frame(s, d)))


@query("expressed_genes", _M + " SELECT var.gene_id, count(x.value)::BIGINT AS n_cells FROM var LEFT JOIN x ON x.gene_id = var.gene_id AND x.value > 0 GROUP BY 1 HAVING count(x.value) >= 10")
def _(s, d):
    return summary.expressed_genes(frame(s, d), 10)


@query("sample_counts", _M + " SELECT sample, count(*) AS n FROM obs GROUP BY 1")
def _(s, d):
    return summary.sample_counts(frame(s, d), "sample")


@query("mean_by_group", _M + ' SELECT label AS "group", gene_id, round(avg(value), 6) AS mean FROM grid JOIN obs USING (cell_id) GROUP BY 1, 2')
def _(s, d):
    return rounded(summary.mean_by_group(frame(s, d), "label"))


@query("pseudobulk_median", _M + " SELECT sample, label AS type, gene_id, round(median(value), 6) AS value FROM grid JOIN obs USING (cell_id) GROUP BY 1, 2, 3")
def _(s, d):
    return rounded(summary.pseudobulk(frame(s, d), "sample", "label", "median"))


@query("pseudobulk_mean", _M + " SELECT sample, label AS type, gene_id, round(avg(value), 6) AS value FROM grid JOIN obs USING (cell_id) GROUP BY 1, 2, 3")
def _(s, d):
    return rounded(summary.pseudobulk(frame(s, d), "sample", "label", "mean"))


@query("label_confusion_edges", "SELECT least(l_returnflag, l_linestatus) AS a, greatest(l_returnflag, l_linestatus) AS b, count(*) AS weight FROM lineitem WHERE l_returnflag <> l_linestatus GROUP BY 1, 2")
def _(s, d):
    return summary.confusion_edges(t(s, d, "lineitem").select(F.col("l_returnflag").alias("cell_type"), F.col("l_linestatus").alias("pred")))


@query("patient_majority", """WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, o_orderstatus AS v, count(*) AS c FROM orders GROUP BY 1, 2),
a AS (SELECT o_custkey, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, v) AS r FROM c) WHERE r = 1), b AS (SELECT o_custkey, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, v) AS r FROM s) WHERE r = 1)
SELECT o_custkey, a.v AS o_orderpriority, b.v AS o_orderstatus FROM a JOIN b USING (o_custkey)""")
def _(s, d):
    return summary.patient_majority(t(s, d, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus")


@query("majority_map", "SELECT l_linestatus, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY c DESC, l_returnflag) AS r FROM (SELECT l_linestatus, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2)) WHERE r = 1")
def _(s, d):
    return summary.map_clusters(t(s, d, "lineitem"), "l_linestatus", "l_returnflag")


@query("mapped_accuracy", "WITH m AS (SELECT l_linestatus, arg_max(l_returnflag, c) AS f FROM (SELECT l_linestatus, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1) SELECT round(avg((l_returnflag = f)::INT), 6) AS accuracy FROM lineitem JOIN m USING (l_linestatus)")
def _(s, d):
    return rounded(summary.mapped_accuracy(t(s, d, "lineitem"), "l_linestatus", "l_returnflag"))


# --- transforms ----------------------------------------------------------------

_XT = _M + ", xt AS (SELECT x.*, t FROM x JOIN tot USING (cell_id))"
_LOG = _XT + ", l AS (SELECT cell_id, gene_id, ln(1 + value / t) AS value FROM xt), gm AS (SELECT gene_id, sum(value) / n AS m, greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n)) AS v FROM l, nc GROUP BY gene_id, n)"
for _name, _sql in {
    "log_shift_size_factor": _XT + " SELECT cell_id, gene_id, round(ln(1 + value / t), 6) AS value FROM xt",
    "arcsinh": _M + " SELECT cell_id, gene_id, round(asinh(0.05 * value), 6) AS value FROM x",
    "log_alpha": _M + " SELECT cell_id, gene_id, round(ln(1 + 0.05 * value), 6) AS value FROM x",
    "log_cpm": _XT + " SELECT cell_id, gene_id, round(ln(1 + value / t * 1e6), 6) AS value FROM xt",
    "log_shift_scale_by_std": _M + ", l AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM x), s AS (SELECT gene_id, sqrt(greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n))) AS sd FROM l, nc GROUP BY gene_id, n) SELECT cell_id, gene_id, round(value / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS value FROM l JOIN s USING (gene_id)",
    "log_shift_size_factor_hvg": _LOG + ", top AS (SELECT gene_id FROM gm ORDER BY v DESC, gene_id LIMIT 8) SELECT cell_id, gene_id, round(value, 6) AS value FROM l JOIN top USING (gene_id)",
    "log_shift_size_factor_z": _LOG + " SELECT obs.cell_id, gm.gene_id, round((coalesce(l.value, 0) - m) / CASE WHEN v = 0 THEN 1 ELSE sqrt(v) END, 6) + 0.0 AS value FROM obs CROSS JOIN gm LEFT JOIN l ON l.cell_id = obs.cell_id AND l.gene_id = gm.gene_id",
    "log_shift_hvg_z": _LOG + ", top AS (SELECT * FROM gm ORDER BY v DESC, gene_id LIMIT 8) SELECT obs.cell_id, top.gene_id, round((coalesce(l.value, 0) - m) / CASE WHEN v = 0 THEN 1 ELSE sqrt(v) END, 6) + 0.0 AS value FROM obs CROSS JOIN top LEFT JOIN l ON l.cell_id = obs.cell_id AND l.gene_id = top.gene_id",
    "scran": _XT + ", g AS (SELECT exp(avg(ln(coalesce(t, 1) + 1e-8))) AS g FROM obs LEFT JOIN tot USING (cell_id)) SELECT cell_id, gene_id, round(ln(1 + value / (t / g)), 6) AS value FROM xt, g",
    "pearson_residuals": _M + ", c AS (SELECT gene_id, sum(value) AS g FROM x GROUP BY 1), s AS (SELECT sum(value) + 1e-10 AS s FROM x), q AS (SELECT grid.*, coalesce(t, 0) * g / s AS mu FROM grid LEFT JOIN tot USING (cell_id) JOIN c USING (gene_id), s) SELECT cell_id, gene_id, round(greatest(-sqrt(n), least(sqrt(n), (value - mu) / sqrt(mu + mu * mu / 100 + 1e-10))), 6) + 0.0 AS value FROM q, nc",
    "sanity": _M + ", s AS (SELECT sum(value) + 1e-10 AS s FROM x) SELECT grid.cell_id, gene_id, round(ln(value / coalesce(t, 1) + n / s), 6) AS value FROM grid LEFT JOIN tot USING (cell_id), s, nc",
    "tmm": _M + """, y AS (SELECT cell_id, gene_id, value + 0.5 AS y FROM grid), lib AS (SELECT cell_id, sum(y) AS lib FROM y GROUP BY 1),
ref AS (SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY lib, cell_id) - 1 AS i FROM lib), nc WHERE i = floor(0.75 * n)),
r AS (SELECT gene_id, y AS yr, lib AS lr FROM y JOIN lib USING (cell_id) JOIN ref USING (cell_id)),
ma AS (SELECT cell_id, gene_id, log2((y / lib) / (yr / lr)) AS m, 0.5 * log2((y / lib) * (yr / lr)) AS a, 1 / ((lib - y) / (lib * y) + (lr - yr) / (lr * yr) + 1e-8) AS w FROM y JOIN lib USING (cell_id) JOIN r USING (gene_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(m, 9), gene_id) - 1 AS im, row_number() OVER (PARTITION BY cell_id ORDER BY round(a, 9), gene_id) - 1 AS ia, count(*) OVER (PARTITION BY cell_id) AS p FROM ma),
b AS (SELECT *, im >= floor(.3 * p) AND im < floor(.7 * p) AS inm, im >= floor(.3 * p) AND im < floor(.7 * p) AND ia >= floor(.3 * p) AND ia < floor(.7 * p) AS both_ FROM k),
u AS (SELECT *, sum(both_::INT) OVER (PARTITION BY cell_id) AS nb FROM b), f AS (SELECT cell_id, pow(2, sum(w * m) / sum(w)) AS f FROM u WHERE CASE WHEN nb < 3 THEN inm ELSE both_ END GROUP BY 1),
g AS (SELECT exp(avg(ln(f + 1e-8))) AS g FROM f) SELECT cell_id, gene_id, round(ln(1 + value / (f / g)), 5) AS value FROM x JOIN f USING (cell_id), g""",
}.items():
    query(f"t_{_name}", _sql)(lambda s, d, n=_name: rounded(transforms.transform(frame(s, d), n).x, 5 if n == "tmm" else 6))


@query("t_box_cox")
def _(s, d):
    return rounded(transforms.transform(frame(s, d), "box_cox").x)


@query("t_glm_pca")
def _(s, d):
    return rounded(transforms.transform(frame(s, d), "glm_pca", n_components=10).x)


@query("hvg_topvar", _LOG + " SELECT gene_id, round(v, 9) AS var FROM gm ORDER BY v DESC, gene_id LIMIT 8")
def _(s, d):
    f = transforms.log_shift_size_factor(frame(s, d))
    return rounded(transforms.top_variance_genes(f), 9)


@query("pca_variance")
def _(s, d):
    _, got = embeddings.run_pca(frame(s, d), 10)
    return embeddings.cumulative_variance(s.createDataFrame([(i + 1, float(v)) for i, v in enumerate(got["ratio"])], "pc int, ratio double"))


@query("pca_embedding")
def _(s, d):
    return embeddings.run_pca(frame(s, d), 10)[0].obsm["X_pca"]


@query("gavish_donoho", "WITH sv AS (SELECT l_linenumber AS pc, sqrt(sum(l_quantity * l_quantity)::DOUBLE) AS sv FROM lineitem GROUP BY 1), m AS (SELECT median(sv) AS m FROM sv) SELECT greatest(1, sum((sv > (0.56 * 0.001 - 0.95 * 0.01 + 1.82 * 0.1 + 1.43) * m)::BIGINT))::BIGINT AS n_components FROM sv, m")
def _(s, d):
    sv = t(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("pc")).agg(F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity")).cast("double")).alias("sv"))
    return embeddings.gavish_donoho_table(sv, 100, 10)


@query("elbow_curvature", """WITH c AS (SELECT row_number() OVER (ORDER BY n_name)::DOUBLE AS x, n_regionkey::DOUBLE * n_nationkey AS y FROM nation),
g AS (SELECT x, y, CASE WHEN lag(y) OVER w IS NULL THEN lead(y) OVER w - y WHEN lead(y) OVER w IS NULL THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2 END AS d1 FROM c WINDOW w AS (ORDER BY x)),
h AS (SELECT *, CASE WHEN lag(d1) OVER w IS NULL THEN lead(d1) OVER w - d1 WHEN lead(d1) OVER w IS NULL THEN d1 - lag(d1) OVER w ELSE (lead(d1) OVER w - lag(d1) OVER w) / 2 END AS d2 FROM g WINDOW w AS (ORDER BY x))
SELECT x, y, round(abs(d2) / pow(1 + d1 * d1, 1.5), 6) AS curvature FROM h ORDER BY abs(d2) / pow(1 + d1 * d1, 1.5) DESC, x LIMIT 1""")
def _(s, d):
    n = t(s, d, "nation")
    return rounded(embeddings.elbow(n.select(F.row_number().over(Window.orderBy("n_name")).cast("double").alias("x"), (F.col("n_regionkey").cast("double") * F.col("n_nationkey")).alias("y"))))


# --- agreement of labellings -----------------------------------------------------

_C = """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS nij FROM lineitem GROUP BY 1, 2), ra AS (SELECT a, sum(nij) AS ai FROM c GROUP BY 1), rb AS (SELECT b, sum(nij) AS bj FROM c GROUP BY 1), n AS (SELECT sum(nij) AS n FROM c),
s AS (SELECT n, (SELECT sum(nij * (nij - 1) / 2) FROM c) AS sij, (SELECT sum(ai * (ai - 1) / 2) FROM ra) AS sa, (SELECT sum(bj * (bj - 1) / 2) FROM rb) AS sb,
(SELECT sum(nij / n.n * ln(n.n * nij / (ai * bj))) FROM c JOIN ra USING (a) JOIN rb USING (b)) AS mi, (SELECT -sum(ai / n.n * ln(ai / n.n)) FROM ra) AS ha, (SELECT -sum(bj / n.n * ln(bj / n.n)) FROM rb) AS hb FROM n)"""
_AGREE = {
    "ari": "(sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))",
    "nmi": "mi / ((ha + hb) / 2)",
    "homogeneity": "mi / ha",
    "completeness": "mi / hb",
    "v_measure": "2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)",
    "fowlkes_mallows": "sij / sqrt(sa * sb)",
    "variation_of_information": "ha + hb - 2 * mi",
}
for _name, _expr in _AGREE.items():
    query(_name, f"{_C} SELECT round({_expr}, 6) AS {_name} FROM s")(lambda s, d, n=_name: rounded(contingency.agreement(t(s, d, "lineitem"), "l_returnflag", "l_linestatus").select(n)))


@query("adjusted_mutual_info")
def _(s, d):
    return s.createDataFrame([(contingency.adjusted_mutual_info(points(s, d), "label", "cluster"),)], "ami double")


# --- neighbours ------------------------------------------------------------------


@query("knn_edges", _E + " SELECT src, dst, r::INT AS rank, round(dd, 6) AS dist FROM nn WHERE r <= 15")
def _(s, d):
    return rounded(neighbors.knn(points(s, d), 15))


@query("confusion_knn", _E + " SELECT 'mod7' AS method, src AS cell_id, round(sum((a.cluster = b.cluster AND a.label <> b.label)::INT) / 50.0, 6) AS confusion FROM nn JOIN e a ON a.cell_id = src JOIN e b ON b.cell_id = dst WHERE r <= 50 GROUP BY src")
def _(s, d):
    p = points(s, d)
    return rounded(neighbors.confusion(neighbors.knn(p, 50), p.select("cell_id", "label", "cluster", F.lit("mod7").alias("method")), 50))


@query("fragmentation", "WITH c AS (SELECT l_returnflag AS label, l_linestatus AS cluster, count(*) AS c FROM lineitem GROUP BY 1, 2), l AS (SELECT label, sum(c) AS n FROM c GROUP BY 1), m AS (SELECT label, sum(c * (1 - c / n)) / max(n) AS fragmentation FROM c JOIN l USING (label) GROUP BY 1) SELECT label, round(fragmentation, 6) AS fragmentation, rank() OVER (ORDER BY -round(fragmentation, 6)) AS review_rank FROM m")
def _(s, d):
    x = t(s, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("cluster"))
    m = neighbors.fragmentation(x).groupBy("label").agg(F.round(F.avg("fragmentation"), 6).alias("fragmentation")).withColumn("_q", -F.col("fragmentation"))
    return m.select("label", "fragmentation", ranks.min_rank("_q").cast("long").alias("review_rank"))


@query("lisi", _E + ", c AS (SELECT src, batch, count(*)::DOUBLE AS c FROM nns JOIN e ON cell_id = dst WHERE r <= 30 GROUP BY 1, 2), v AS (SELECT src, 1 / (sum(c * c) / pow(sum(c), 2) + 1e-10) AS v FROM c GROUP BY 1) SELECT round(avg(v), 6) AS lisi FROM v")
def _(s, d):
    p = points(s, d)
    return rounded(neighbors.lisi(neighbors.knn(p, 30, include_self=True), p.select("cell_id", "batch")))


@query("kbet", _E + ", f AS (SELECT batch, count(*) * 20.0 / (SELECT count(*) FROM e) AS ex FROM e GROUP BY 1), c AS (SELECT src, batch, count(*) AS o FROM nns JOIN e ON cell_id = dst WHERE r <= 20 GROUP BY 1, 2), x AS (SELECT cell_id, sum(pow(coalesce(o, 0) - ex, 2) / (ex + 1e-10)) AS x FROM e CROSS JOIN f LEFT JOIN c ON c.src = e.cell_id AND c.batch = f.batch GROUP BY 1) SELECT round(avg((x <= 5.991464547107979)::INT), 6) AS kbet FROM x")
def _(s, d):
    p = points(s, d)
    return rounded(neighbors.kbet(neighbors.knn(p, 20, include_self=True), p.select("cell_id", "batch"), 20))


_SIL = _E + """, m AS (SELECT src, b.{g} AS g, sum(dd) AS s, count(*) AS c FROM dist JOIN e b ON b.cell_id = dst GROUP BY 1, 2),
ab AS (SELECT m.src, e.{g} AS own, max(CASE WHEN m.g = e.{g} THEN s / nullif(c - 1, 0) END) AS a, min(CASE WHEN m.g <> e.{g} THEN s / c END) AS b FROM m JOIN e ON e.cell_id = m.src GROUP BY 1, 2),
si AS (SELECT src, own, CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM ab)"""


@query("silhouette_label", _SIL.format(g="label") + " SELECT own AS label, round(avg(s), 6) + 0.0 AS silhouette FROM si GROUP BY 1")
def _(s, d):
    p = points(s, d)
    return rounded(neighbors.silhouette(p.select("cell_id", "vec", F.col("label").alias("cluster"))).groupBy(F.col("cluster").alias("label")).agg(F.avg("silhouette").alias("silhouette")))


@query("batch_asw", _SIL.format(g="batch") + " SELECT round(-avg(s), 6) + 0.0 AS batch_asw FROM si")
def _(s, d):
    p = points(s, d)
    return rounded(neighbors.silhouette(p.select("cell_id", "vec", F.col("batch").alias("cluster"))).agg((-F.avg("silhouette")).alias("batch_asw")))


_E2 = _E + ", lo AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.vec[1:8], b.vec[1:8]) AS dd FROM e a CROSS JOIN e b), ln AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dd, dst) AS r FROM lo), lx AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dd, dst) AS r FROM lo WHERE src <> dst)"


def _low(s, d):
    return points(s, d).withColumn("vec", F.slice("vec", 1, 8))


@query("knn_preservation", _E2 + " SELECT round(count(*) / 10.0 / (SELECT count(*) FROM e), 6) AS preservation FROM nns JOIN ln USING (src, dst) WHERE nns.r <= 10 AND ln.r <= 10")
def _(s, d):
    return rounded(neighbors.shared_neighbours(neighbors.knn(points(s, d), 10, True), neighbors.knn(_low(s, d), 10, True), 10))


@query("knn_overlap", _E2 + " SELECT round(count(*) / 10.0 / (SELECT count(*) FROM e), 6) AS overlap FROM nn JOIN lx USING (src, dst) WHERE nn.r BETWEEN 2 AND 11 AND lx.r BETWEEN 2 AND 11")
def _(s, d):
    return rounded(neighbors.knn_overlap(neighbors.knn(points(s, d), 11), neighbors.knn(_low(s, d), 11), 10))


@query("trustworthiness", _E2 + " SELECT round(1 - 2.0 / ((SELECT count(*) FROM e) * 10 * (2 * (SELECT count(*) FROM e) - 31)) * sum(nn.r - 10), 6) AS trustworthiness FROM lx JOIN nn USING (src, dst) WHERE lx.r <= 10 AND nn.r > 10")
def _(s, d):
    return s.createDataFrame([(round(neighbors.trustworthiness(points(s, d), _low(s, d), 10), 6),)], "trustworthiness double")


@query("label_transfer_knn", _E + ", n2 AS (SELECT q.cell_id AS src, r.cell_id AS dst, r.label, row_number() OVER (PARTITION BY q.cell_id ORDER BY list_distance(q.vec, r.vec), r.cell_id) AS k FROM e q CROSS JOIN e r WHERE q.cell_id % 5 = 0 AND r.cell_id % 5 <> 0), v AS (SELECT src, label, count(*) AS c FROM n2 WHERE k <= 15 GROUP BY 1, 2) SELECT src, label AS pred, round(c / 15.0, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, label) AS i FROM v) WHERE i = 1")
def _(s, d):
    p = points(s, d)
    ref, q = p.where("cell_id % 5 <> 0"), p.where("cell_id % 5 = 0")
    return rounded(neighbors.vote(neighbors.knn(q, 15, True, ref.select("cell_id", "vec")), ref))


@query("bbknn_edges", _E + " SELECT src, dst, batch, r::INT AS rank, round(dd, 6) AS dist FROM (SELECT src, dst, batch, dd, row_number() OVER (PARTITION BY src, batch ORDER BY dd, dst) AS r FROM dist JOIN e ON cell_id = dst) WHERE r <= 3")
def _(s, d):
    p = points(s, d)
    return rounded(neighbors.batch_balanced_edges(p.select("cell_id", "vec"), p.select("cell_id", "batch")))


@query("graph_connectivity", _E + " SELECT round(avg(m), 6) AS connectivity FROM (SELECT src, max((a.batch <> b.batch)::INT) AS m FROM nn JOIN e a ON a.cell_id = src JOIN e b ON b.cell_id = dst WHERE r <= 3 GROUP BY 1)")
def _(s, d):
    p = points(s, d)
    return rounded(neighbors.graph_connectivity(neighbors.knn(p, 3), p.select("cell_id", "batch")))


@query("calinski_harabasz")
def _(s, d):
    return rounded(clustering.calinski_harabasz(points(s, d).select("cell_id", "vec", "cluster")))


@query("davies_bouldin")
def _(s, d):
    return rounded(clustering.davies_bouldin(points(s, d).select("cell_id", "vec", "cluster")))


# --- label quality ----------------------------------------------------------------


def _predictions(p: DataFrame) -> DataFrame:
    """Three stand-in models that a query language can repeat exactly."""
    arr = F.array(*[F.struct(F.lit(f"m{k}").alias("model"), F.when(F.pmod(F.col("cell_id") * k, F.lit(5)) == 0, ((F.col("label").cast("int") + k) % 10).cast("string")).otherwise(F.col("label")).alias("pred"), (0.5 + F.pmod(F.col("cell_id") * k, F.lit(10)) / 20.0).alias("confidence")) for k in (1, 2, 3)])
    return p.select("cell_id", F.explode(arr).alias("e")).select("cell_id", "e.model", "e.pred", "e.confidence")


def _methods(p: DataFrame) -> DataFrame:
    """Two deterministic clusterings as a long table."""
    arr = F.array(F.struct(F.lit("top1").alias("method"), (F.col("cell_id") % 7).cast("string").alias("cluster")), F.struct(F.lit("top2").alias("method"), ((F.col("label").cast("int") + F.col("cell_id") % 2) % 10).cast("string").alias("cluster")))
    return p.select("cell_id", "label", F.explode(arr).alias("e")).select("cell_id", "label", "e.method", "e.cluster")


def label_quality_cells(s: SparkSession, d: str) -> DataFrame:
    """Per-cell columns of both arms."""
    p = points(s, d)
    m = _methods(p)
    conf = neighbors.confusion(neighbors.knn(p, 50), m, 50)
    frag = neighbors.fragmentation(m, ["method"])
    wide = lambda df, col: df.groupBy("cell_id").pivot("method", ["top1", "top2"]).agg(F.first(col)).select("cell_id", F.col("top1").alias(f"top1_{col}"), F.col("top2").alias(f"top2_{col}"))
    return p.select("cell_id", "label").join(wide(conf, "confusion"), "cell_id").join(wide(frag, "fragmentation"), "cell_id").join(quality.consensus(_predictions(p)), "cell_id")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The 16 label-quality scores of the embeddings' labels."""
    conf, frag = ["top1_confusion", "top2_confusion"], ["top1_fragmentation", "top2_fragmentation"]
    means = quality.label_means(label_quality_cells(s, d), "label", [*conf, *frag, *quality.SUPERVISED])
    sil = neighbors.silhouette(points(s, d).select("cell_id", "vec", F.col("label").alias("cluster"))).groupBy(F.col("cluster").alias("label")).agg(F.avg("silhouette").alias("silhouette"))
    return rounded(quality.variants(means.join(sil, "label", "left"), conf, frag))


_PRED = "pr AS (" + " UNION ALL ".join(f"SELECT cell_id, CASE WHEN (cell_id * {k}) % 5 = 0 THEN ((label::INT + {k}) % 10)::VARCHAR ELSE label END AS pred, 0.5 + ((cell_id * {k}) % 10) / 20.0 AS confidence FROM e" for k in (1, 2, 3)) + ")"
_CONS = _PRED + """, vt AS (SELECT cell_id, pred, count(*)::DOUBLE AS v FROM pr GROUP BY 1, 2), vp AS (SELECT *, v / sum(v) OVER (PARTITION BY cell_id) AS p, row_number() OVER (PARTITION BY cell_id ORDER BY v DESC, pred) AS r FROM vt),
cs AS (SELECT cell_id, max(CASE WHEN r = 1 THEN pred END) AS pred_consensus, max(p) AS pred_agreement, -sum(p * log2(p + 1e-12)) AS pred_entropy FROM vp GROUP BY 1), cc AS (SELECT cell_id, avg(confidence)::DOUBLE AS pred_avg_confidence FROM pr GROUP BY 1)"""


@query("consensus_entropy", _E.split(",\ndist")[0] + ", " + _CONS + " SELECT cell_id, pred_consensus, round(pred_agreement, 6) AS pred_agreement, round(pred_entropy, 6) + 0.0 AS pred_entropy, round(pred_avg_confidence, 6) AS pred_avg_confidence FROM cs JOIN cc USING (cell_id)")
def _(s, d):
    return rounded(quality.consensus(_predictions(points(s, d))))


_LQ = _SIL.format(g="label") + ", " + _CONS + """, md AS (SELECT cell_id, label, 1 AS k, (cell_id % 7)::VARCHAR AS cl FROM e UNION ALL SELECT cell_id, label, 2, ((label::INT + cell_id % 2) % 10)::VARCHAR FROM e),
cf AS (SELECT a.k, a.cell_id, a.label, sum((a.cl = b.cl AND a.label <> b.label)::INT) / 50.0 AS c FROM nn JOIN md a ON a.cell_id = src JOIN md b ON b.cell_id = dst AND b.k = a.k WHERE r <= 50 GROUP BY 1, 2, 3),
fr AS (SELECT k, label, 1 - count(*) OVER (PARTITION BY k, label, cl) / count(*) OVER (PARTITION BY k, label) AS f FROM md),
mm AS (SELECT e.label, (SELECT avg(c) FROM cf WHERE k = 1 AND cf.label = e.label) AS c1, (SELECT avg(c) FROM cf WHERE k = 2 AND cf.label = e.label) AS c2, (SELECT avg(f) FROM fr WHERE k = 1 AND fr.label = e.label) AS f1, (SELECT avg(f) FROM fr WHERE k = 2 AND fr.label = e.label) AS f2,
avg(pred_agreement) AS a, avg(pred_entropy) AS en, avg(pred_avg_confidence) AS co, (SELECT avg(s) FROM si WHERE own = e.label) AS sil FROM e JOIN cs USING (cell_id) JOIN cc USING (cell_id) GROUP BY e.label),
u AS (SELECT *, """ + ", ".join(f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) AS u_{c}" for c in ("c1", "c2", "f1", "f2", "a", "en", "co")) + """ FROM mm),
g AS (SELECT *, (1 - u_c1) + (1 - u_c2) AS gc, (1 - u_f1) + (1 - u_f2) AS gf, 2 * (u_a + (1 - u_en) + u_co) AS gs FROM u),
k AS (SELECT *, (gc + gs) / 8 AS k, (gc + gs + gf) / 10 AS kf FROM g),
rk AS (SELECT *, (rank() OVER (ORDER BY round(k, 12)) + (count(*) OVER (PARTITION BY round(k, 12)) - 1) / 2.0 - 0.5) / count(*) OVER () AS rs, (rank() OVER (ORDER BY round(kf, 12)) + (count(*) OVER (PARTITION BY round(kf, 12)) - 1) / 2.0 - 0.5) / count(*) OVER () AS rf,
(rank() OVER (ORDER BY round(sil, 12)) + (count(*) OVER (PARTITION BY round(sil, 12)) - 1) / 2.0 - 0.5) / count(*) OVER () AS rg FROM k),
va AS (SELECT label, k AS composite, kf AS composite_frag, (rs + rg) / 2 AS composite_silhouette, (rf + rg) / 2 AS composite_frag_silhouette, -(2.469469952903643 - 1.8297248915285826 * rs - 4.958684167833358 * rg) AS fusion_add, -(2.9277555346275688 - 2.806706408259526 * rs - 6.399737857821906 * rg + 2.9943287500623796 * rs * rg) AS fusion_log,
gc / 2 AS unsup_only, gs / 6 AS sup_only, (gc + gf) / 4 AS unsup_frag_only, -c1 AS confusion_top1, -(c1 + c2) / 2 AS confusion_mean, -(f1 + f2) / 2 AS fragmentation_mean, a AS pred_agreement, -en AS pred_entropy, co AS pred_avg_confidence, sil AS silhouette FROM rk)"""


@query("label_quality_variants", _LQ + " SELECT label, " + ", ".join(f"round({v}, 6) + 0.0 AS {v}" for v in quality.VARIANTS) + " FROM va")
def _(s, d):
    return flagship(s, d)


@query("review_ranks", _LQ + " SELECT label, " + ", ".join(f"rank() OVER (ORDER BY round({v}, 6)) AS {v}" for v in quality.VARIANTS) + " FROM va")
def _(s, d):
    return quality.review_ranks(flagship(s, d))


@query("quality_rank", "SELECT n_name AS label, round((rank() OVER (ORDER BY n_regionkey) + (count(*) OVER (PARTITION BY n_regionkey) - 1) / 2.0 - 0.5) / count(*) OVER (), 6) AS r FROM nation")
def _(s, d):
    return rounded(t(s, d, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").cast("double").alias("v")).select("label", ranks.quality_rank("v").alias("r")))


_BR = "WITH m AS (SELECT p_brand AS method, round(avg(p_size), 4) AS m1, round(avg(p_retailprice), 4) AS m2 FROM part GROUP BY 1)"


def _brands(s, d):
    return t(s, d, "part").groupBy(F.col("p_brand").alias("method")).agg(F.round(F.avg("p_size"), 4).alias("m1"), F.round(F.avg("p_retailprice"), 4).cast("double").alias("m2"))


@query("borda", _BR + ", r AS (SELECT method, (rank() OVER (ORDER BY m1 DESC) + (count(*) OVER (PARTITION BY m1) - 1) / 2.0) + (rank() OVER (ORDER BY m2 DESC) + (count(*) OVER (PARTITION BY m2) - 1) / 2.0) AS b FROM m) SELECT method, round(b, 6)::DOUBLE AS borda_score, rank() OVER (ORDER BY b) AS borda_rank FROM r")
def _(s, d):
    return rounded(quality.borda(_brands(s, d), ["m1", "m2"])).withColumn("borda_rank", F.col("borda_rank").cast("long"))


@query("pareto", _BR + " SELECT method, m1, m2::DOUBLE AS m2 FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.m1 >= a.m1 AND b.m2 >= a.m2 AND (b.m1 > a.m1 OR b.m2 > a.m2))")
def _(s, d):
    return quality.pareto(_brands(s, d), ["m1", "m2"])


# --- tests per gene -----------------------------------------------------------------

_G = _M + ", g AS (SELECT grid.*, obs.label, obs.condition FROM grid JOIN obs USING (cell_id))"
_RK = _G + ", w AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene_id, value)::DOUBLE AS t, count(*) OVER (PARTITION BY gene_id)::DOUBLE AS n FROM g)"
_MO = _G + ", m AS (SELECT gene_id, condition, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM g GROUP BY 1, 2), p AS (SELECT a.gene_id, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM m a JOIN m b ON a.gene_id = b.gene_id AND a.condition = 'pos' AND b.condition = 'neg')"


@query("wilcoxon_u", _RK + ", q AS (SELECT gene_id, sum((condition = 'pos')::INT)::DOUBLE AS n1, sum((condition = 'neg')::INT)::DOUBLE AS n2, sum(CASE WHEN condition = 'pos' THEN rk END) AS r1, sum(t * t - 1) AS ties FROM w GROUP BY 1), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS s2 FROM q) SELECT gene_id, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 4) AS u, round(greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(s2), 6) AS z FROM u")
def _(s, d):
    u = tests_de.mann_whitney(frame(s, d), "condition", "pos", "neg")
    return u.select("gene_id", "n1", "n2", F.round("u", 4).alias("u"), F.round("z", 6).alias("z"))


@query("wilcoxon_de")
def _(s, d):
    return rounded(tests_de.wilcoxon_de(frame(s, d), "condition", "pos", "neg"))


@query("welch_t", _MO + " SELECT gene_id, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM p")
def _(s, d):
    w = tests_de.welch(frame(s, d), "condition", "pos", "neg")
    return w.select("gene_id", (F.round("t", 6) + 0.0).alias("t"), F.round("df", 4).alias("df"))


@query("ttest_de")
def _(s, d):
    return rounded(tests_de.ttest_de(frame(s, d), "condition", "pos", "neg"))


@query("cohens_hedges", _MO + ", c AS (SELECT gene_id, n1, n2, (m1 - m2) / (sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) + 1e-10) AS c FROM p) SELECT gene_id, round(c, 6) + 0.0 AS cohens_d, round(c * (1 - 3 / (4 * (n1 + n2 - 2) - 1)), 6) + 0.0 AS hedges_g FROM c")
def _(s, d):
    return rounded(tests_de.effect_sizes(frame(s, d), "condition", "pos", "neg"))


@query("anova_f", _G + ", m AS (SELECT gene_id, label, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM g GROUP BY 1, 2), a AS (SELECT gene_id, sum(n) AS n, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum((n - 1) * v) AS w FROM m GROUP BY 1) SELECT gene_id, round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 5) AS f FROM a")
def _(s, d):
    return tests_de.anova(frame(s, d), "label").select("gene_id", F.round("f", 5).alias("f"))


@query("kruskal_h", _RK + ", q AS (SELECT gene_id, label, sum(rk) AS r, count(*)::DOUBLE AS c, max(n) AS n FROM w GROUP BY 1, 2), ti AS (SELECT gene_id, sum(t * t - 1) AS ties FROM w GROUP BY 1) SELECT gene_id, round((12 / (max(n) * (max(n) + 1)) * sum(r * r / c) - 3 * (max(n) + 1)) / (1 - max(ties) / (pow(max(n), 3) - max(n))), 5) AS h FROM q JOIN ti USING (gene_id) GROUP BY 1")
def _(s, d):
    return tests_de.kruskal(frame(s, d), "label").select("gene_id", F.round("h", 5).alias("h"))


@query("dunn_posthoc")
def _(s, d):
    f = frame(s, d)
    return rounded(tests_de.dunn(f, f.var.agg(F.min("gene_id")).first()[0], "label"))


@query("rank_genes_groups")
def _(s, d):
    return rounded(tests_de.rank_genes(frame(s, d), "label", 10))


@query("pseudobulk_de")
def _(s, d):
    return rounded(tests_de.pseudobulk_de(frame(s, d), "condition", "sample"))


@query("permutation_de")
def _(s, d):
    return rounded(tests_de.permutation_de(frame(s, d), "condition", "pos", "neg", 50))


_P = "WITH p AS (SELECT n_name AS id, (n_nationkey + 1) * (n_nationkey + 1) / 2000.0 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p)"
for _name, _expr in {
    "fdr_bh": "least(1, min(p * n / i) OVER (ORDER BY i DESC))",
    "fdr_by": "least(1, min(p * n / i * (SELECT sum(1.0 / i) FROM r)) OVER (ORDER BY i DESC))",
    "holm": "least(1, max(p * (n - i + 1)) OVER (ORDER BY i))",
    "bonferroni": "least(1, p * n)",
}.items():
    query(f"adjust_{_name}", f"{_P} SELECT id, round(({_expr})::DOUBLE, 8) AS p_adjusted FROM r")(
        lambda s, d, m=_name: rounded(ranks.adjust_pvalues(t(s, d, "nation").select(F.col("n_name").alias("id"), ((F.col("n_nationkey") + 1) * (F.col("n_nationkey") + 1) / 2000.0).cast("double").alias("p_value")), method=m, tie="id").select("id", "p_adjusted"), 8)
    )


@query("ora_counts", "WITH bg AS (SELECT DISTINCT p_partkey AS gene, p_type AS set_ FROM part), q AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity >= 50) SELECT set_ AS \"set\", sum((q.gene IS NOT NULL)::INT)::BIGINT AS a, (SELECT count(*) FROM q) - sum((q.gene IS NOT NULL)::INT)::BIGINT AS b, sum((q.gene IS NULL)::INT)::BIGINT AS c, ((SELECT count(*) FROM bg) - (SELECT count(*) FROM q) - sum((q.gene IS NULL)::INT))::BIGINT AS d FROM bg LEFT JOIN q USING (gene) GROUP BY 1")
def _(s, d):
    p = t(s, d, "part")
    q = t(s, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("gene"))
    return tests_de.ora_counts(q, p.select(F.col("p_partkey").alias("gene")), p.select(F.col("p_type").alias("set"), F.col("p_partkey").alias("gene")))


@query("over_representation")
def _(s, d):
    p = t(s, d, "part")
    q = t(s, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("gene"))
    return rounded(tests_de.over_representation(q, p.select(F.col("p_partkey").alias("gene")), p.select(F.col("p_type").alias("set"), F.col("p_partkey").alias("gene"))))


def _markers(f: CellFrame) -> DataFrame:
    i = F.row_number().over(Window.orderBy("gene_id")) - 1
    return f.var.select("gene_id", F.concat(F.lit("type"), (i % 4).cast("string")).alias("type"), (i % 4).alias("type_ord"))


@query("marker_threshold", _M + ", mk AS (SELECT gene_id, (row_number() OVER (ORDER BY gene_id) - 1) % 4 AS o FROM var), s AS (SELECT cell_id, o, avg((value > 1.5)::INT) AS s FROM grid JOIN mk USING (gene_id) GROUP BY 1, 2) SELECT cell_id, 'type' || o AS predicted, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, o) AS r FROM s) WHERE r = 1")
def _(s, d):
    f = frame(s, d)
    return rounded(tests_de.annotate(f, _markers(f), method="threshold", threshold=1.5))


@query("volcano", _MO + ", q AS (SELECT gene_id, log2((m1 + 0.01) / (m2 + 0.01)) AS f FROM p) SELECT gene_id, CASE WHEN abs(f) >= 0.05 AND f > 0 THEN 'up' WHEN abs(f) >= 0.05 THEN 'down' ELSE 'not_significant' END AS regulation FROM q")
def _(s, d):
    w = tests_de.welch(frame(s, d), "condition", "pos", "neg").select("gene_id", tests_de.log2fc(F.col("mean1"), F.col("mean2"), 0.01).alias("log2fc"), F.lit(0.0).alias("p_adjusted"))
    return summary.volcano(w, 0.05).select("gene_id", "regulation")


# --- classification and resampling -----------------------------------------------------


@query("classification_metrics", """WITH c AS (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS p, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), k AS (SELECT DISTINCT t AS k FROM c UNION SELECT p FROM c),
m AS (SELECT k, coalesce((SELECT sum(n) FROM c WHERE t = k), 0) AS t, coalesce((SELECT sum(n) FROM c WHERE p = k), 0) AS p, coalesce((SELECT sum(n) FROM c WHERE t = k AND p = k), 0) AS c FROM k),
a AS (SELECT sum(c) AS c, sum(t) AS s, sum(p * t) AS pt, sum(p * p) AS pp, sum(t * t) AS tt, avg(coalesce(c / nullif(p, 0), 0)) AS pr, avg(coalesce(c / nullif(t, 0), 0)) AS re, avg(coalesce(2 * c / nullif(t + p, 0), 0)) AS f1, avg(CASE WHEN t > 0 THEN c / t END) AS ba FROM m)
SELECT round(c / s, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(1 - pr, 6) AS fdr, round(1 - re, 6) AS fnr, round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc, round((c / s - pt / (s * s)) / (1 - pt / (s * s)), 6) AS kappa, round(ba, 6) AS balanced_accuracy FROM a""")
def _(s, d):
    return rounded(classification.metrics(t(s, d, "labels"), "quality", "toxic"))


@query("auroc", "WITH r AS (SELECT (l_returnflag = 'R') AS y, l_quantity::DOUBLE AS s FROM lineitem), k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM r), c AS (SELECT s, sum(y::INT)::DOUBLE AS p, count(*)::DOUBLE AS n FROM r GROUP BY 1), q AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS sn FROM c) SELECT round((sum(CASE WHEN y THEN rk END) - sum(y::INT)::DOUBLE * (sum(y::INT) + 1) / 2) / (sum(y::INT)::DOUBLE * sum((NOT y)::INT)), 6) AS auroc, (SELECT round(sum(p * tp / sn) / sum(p), 6) FROM q) AS average_precision FROM k")
def _(s, d):
    li = t(s, d, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), F.col("l_quantity").cast("double").alias("s"))
    return rounded(classification.auroc(li, "y", "s"))


@query("mcnemar_counts", "WITH x AS (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels), c AS (SELECT sum((a AND NOT b)::INT)::BIGINT AS b, sum((NOT a AND b)::INT)::BIGINT AS c FROM x) SELECT b, c, round(CASE WHEN b + c = 0 THEN 0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END, 6)::DOUBLE AS statistic FROM c")
def _(s, d):
    x = t(s, d, "labels").select(F.lit(1).alias("y"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return rounded(classification.mcnemar_counts(x, "y", "a", "b"))


_H = "(('0x' || substr(md5({}), 1, 8))::BIGINT)"


@query("stratified_folds", "SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY " + _H.format("'42:' || doc_id") + ", doc_id) - 1) % 5)::INT AS fold FROM labels")
def _(s, d):
    return classification.stratified_folds(t(s, d, "labels"), "quality", "doc_id", 5).select("doc_id", "fold")


@query("no_information_rate", "WITH c AS (SELECT quality, count(*)::DOUBLE AS c FROM labels GROUP BY 1) SELECT round(sum(c * c) / pow(sum(c), 2), 6) AS rate FROM c")
def _(s, d):
    return rounded(resampling.no_information_rate(t(s, d, "labels"), "quality"))


_V = "WITH v AS (SELECT s_suppkey - 1 AS i, s_acctbal::DOUBLE AS value FROM supplier), n AS (SELECT count(*) AS n FROM v), dr AS (SELECT b, " + _H.format("'42:' || b || ':' || i") + " % n AS i FROM v, n, range({b}) t(b)), m AS (SELECT b, avg(value) AS m FROM dr JOIN v USING (i) GROUP BY 1)"


def _values(s, d):
    return t(s, d, "supplier").select((F.col("s_suppkey") - 1).alias("i"), F.col("s_acctbal").cast("double").alias("value"))


@query("bootstrap_mean_ci", _V.format(b=200) + " SELECT (SELECT round(avg(value), 4) FROM v) AS mean, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high FROM m")
def _(s, d):
    return rounded(resampling.bootstrap_mean_ci(_values(s, d), 200), 4)


@query("bca_mean_ci")
def _(s, d):
    r = resampling.bca_mean_ci(_values(s, d), 200)
    return s.createDataFrame([(r["mean"], r["ci_low"], r["ci_high"])], "mean double, ci_low double, ci_high double")


@query("jackknife_after_bootstrap")
def _(s, d):
    return rounded(resampling.jackknife_after_bootstrap(_values(s, d), 200), 4)


def _two_methods(s, d):
    return t(s, d, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("a"), F.col("toxic").alias("b"))


@query("permutation_pvalue", "WITH r AS (SELECT doc_id AS i, (quality - toxic)::DOUBLE AS d FROM labels), n AS (SELECT count(*)::DOUBLE AS n, sum(d) / count(*) AS diff FROM r), p AS (SELECT b, sum(d * CASE WHEN " + _H.format("'42:' || b || ':' || i") + " % 2 = 0 THEN 1 ELSE -1 END) / max(n) AS v FROM r, n, range(200) t(b) GROUP BY 1) SELECT round(max(diff), 6) AS diff, round((sum((abs(v) >= abs(diff) - 1e-12)::INT) + 1) / 201.0, 6)::DOUBLE AS p_value FROM p, n")
def _(s, d):
    return rounded(resampling.permutation_pvalue(_two_methods(s, d), 200))


@query("icc", "WITH g AS (SELECT l_linenumber AS t, count(*)::DOUBLE AS k, avg(l_quantity)::DOUBLE AS m, sum(l_quantity * l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1), s AS (SELECT avg(k) AS k, var_samp(m) * avg(k) AS b, sum(q - k * m * m) / (sum(k) - count(*)) AS w FROM g) SELECT round(least(1, greatest(0, (b - w) / (b + (k - 1) * w))), 6) + 0.0 AS icc FROM s")
def _(s, d):
    return rounded(resampling.icc(t(s, d, "lineitem").select(F.col("l_linenumber").alias("target"), F.col("l_quantity").cast("double").alias("value"))))


@query("time_budget", "WITH e AS (SELECT n_name AS method, (n_nationkey * 7 % 11 + 1)::DOUBLE AS seconds FROM nation), r AS (SELECT *, sum(seconds) OVER (ORDER BY seconds, method ROWS UNBOUNDED PRECEDING) AS running FROM e) SELECT *, running <= 60 AS fits FROM r")
def _(s, d):
    return resampling.time_budget(t(s, d, "nation").select(F.col("n_name").alias("method"), (F.col("n_nationkey") * 7 % 11 + 1).cast("double").alias("seconds")), 60.0)


@query("co_clustering", "WITH a AS (SELECT vec_id AS c, 'r1' AS run, (vec_id % 7)::VARCHAR AS k FROM embeddings UNION ALL SELECT vec_id, 'r2', (vec_id % 5)::VARCHAR FROM embeddings) SELECT x.c AS a, y.c AS b, round(count(*) / 2.0, 6)::DOUBLE AS share FROM a x JOIN a y ON x.run = y.run AND x.k = y.k AND x.c < y.c GROUP BY 1, 2")
def _(s, d):
    p = points(s, d)
    runs = p.select("cell_id", F.explode(F.array(F.struct(F.lit("r1").alias("run"), (F.col("cell_id") % 7).cast("string").alias("cluster")), F.struct(F.lit("r2").alias("run"), (F.col("cell_id") % 5).cast("string").alias("cluster")))).alias("e")).select("cell_id", "e.run", "e.cluster")
    return rounded(clustering.co_occurrence(runs))


for _m in ("LogisticRegression", "NaiveBayes", "KNN", "LDA", "QDA"):

    @query(f"model_{_m.lower()}")
    def _(s, d, m=_m):
        p = points(s, d).select("cell_id", "vec", "label")
        return classification.predict(p.where("cell_id % 5 <> 0"), p.where("cell_id % 5 = 0"), m)


@query("kmeans")
def _(s, d):
    return clustering.kmeans(points(s, d), 5, n_init=1)[0]


@query("communities")
def _(s, d):
    return clustering.communities(neighbors.knn(points(s, d), 15))


@query("hierarchical")
def _(s, d):
    return clustering.hierarchical(points(s, d), 5, method="average")


# --- choice of genes, batches, layouts ----------------------------------------------------


@query("hvg_pearson_residuals", _M + ", c AS (SELECT gene_id, sum(value) AS g FROM x GROUP BY 1), s AS (SELECT sum(value) + 1e-10 AS s FROM x), q AS (SELECT grid.*, coalesce(t, 0) * g / s AS mu FROM grid LEFT JOIN tot USING (cell_id) JOIN c USING (gene_id), s) SELECT gene_id, round(var_pop(greatest(-sqrt(n), least(sqrt(n), (value - mu) / sqrt(mu + mu * mu / 100 + 1e-10)))), 5) AS score FROM q, nc GROUP BY 1")
def _(s, d):
    return rounded(feature_selection.highly_variable(frame(s, d), "pearson_residuals", 8).select("gene_id", "score"), 5)


@query("hvg_cell_ranger", _M + ", m AS (SELECT gene_id, avg(value) AS mean, var_samp(value) AS var FROM grid GROUP BY 1), d AS (SELECT *, var / nullif(mean, 0) AS d, ntile(20) OVER (ORDER BY mean, gene_id) AS bin FROM m), mid AS (SELECT bin, median(d) AS mid FROM d GROUP BY 1), o AS (SELECT d.*, mid, abs(d - mid) AS off FROM d JOIN mid USING (bin)), mad AS (SELECT bin, median(off) AS mad FROM o GROUP BY 1) SELECT gene_id, round(coalesce((d - mid) / nullif(mad, 0), 0), 5) + 0.0 AS score FROM o JOIN mad USING (bin)")
def _(s, d):
    return rounded(feature_selection.highly_variable(frame(s, d), "cell_ranger", 8).select("gene_id", "score"), 5)


@query("hvg_seurat_v3")
def _(s, d):
    return feature_selection.highly_variable(frame(s, d), "seurat_v3", 8)


@query("binned_information", _M + ", cu AS (SELECT gene_id, list_distinct(quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS c FROM grid GROUP BY 1), b AS (SELECT cell_id, gene_id, label, len(list_filter(c, lambda z: z <= value)) AS bin FROM grid JOIN cu USING (gene_id) JOIN obs USING (cell_id)), j AS (SELECT gene_id, bin, label, count(*)::DOUBLE AS nij FROM b GROUP BY 1, 2, 3), k AS (SELECT *, sum(nij) OVER (PARTITION BY gene_id, bin) AS ni, sum(nij) OVER (PARTITION BY gene_id, label) AS nj, sum(nij) OVER (PARTITION BY gene_id) AS n FROM j) SELECT gene_id, round(sum(nij / n * ln(nij * n / (ni * nj))), 8) + 0.0 AS mi FROM k GROUP BY 1")
def _(s, d):
    f = frame(s, d)
    return rounded(feature_selection.binned_information(feature_selection.binned(f).join(f.obs.select("cell_id", "label"), "cell_id"), ["gene_id"], "bin", "label"), 8)


@query("mrmr")
def _(s, d):
    return feature_selection.mrmr(frame(s, d), "label", 3)


@query("mutual_information")
def _(s, d):
    return feature_selection.mutual_information(frame(s, d), "label", 10)


@query("shadow_features")
def _(s, d):
    return feature_selection.shadow_features(frame(s, d), "label", 20)


@query("component_regression", "WITH e AS (SELECT (vec_id % 3) AS b, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pc FROM embeddings), c AS (SELECT b, pc, v, dense_rank() OVER (ORDER BY b) AS code FROM e), r AS (SELECT pc, regr_r2(v, code) AS r2, var_pop(v) AS var FROM c GROUP BY 1) SELECT round(sum(r2 * var) / sum(var), 8) AS score FROM r")
def _(s, d):
    return rounded(batch.component_regression(points(s, d)), 8)


@query("combat")
def _(s, d):
    return rounded(batch.combat(frame(s, d), "batch").layers["combat"])


@query("harmony")
def _(s, d):
    return batch.harmony(points(s, d))


@query("mutual_neighbours")
def _(s, d):
    return batch.mutual_neighbours(points(s, d))


@query("normality_per_gene")
def _(s, d):
    return rounded(diagnostics.normality_per_gene(frame(s, d)))


@query("box_m")
def _(s, d):
    r = diagnostics.box_m(points(s, d).select("cell_id", F.slice("vec", 1, 8).alias("vec"), F.col("batch").alias("grp")))
    return s.createDataFrame([(r["m"], r["p_value"], r["recommendation"])], "m double, p_value double, recommendation string")


for _m in ("umap", "tsne", "diffusion_map", "force_directed"):

    @query(_m)
    def _(s, d, m=_m):
        return getattr(layouts, m)(points(s, d))


@query("spectral_clustering")
def _(s, d):
    return layouts.spectral_clustering(points(s, d), 5)


# --- tables behind figures --------------------------------------------------------------


@query("plot_flows", _E + " SELECT cluster, label, count(*) AS n FROM e GROUP BY 1, 2")
def _(s, d):
    return plot_tables.flows(points(s, d), "cluster", "label")


@query("plot_gene_quartiles", _M + ' SELECT gene_id, batch AS "group", count(*) AS n, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM grid JOIN obs USING (cell_id) GROUP BY 1, 2')
def _(s, d):
    f = frame(s, d)
    return rounded(plot_tables.gene_quartiles(f, [r[0] for r in f.var.select("gene_id").collect()], "batch"))


@query("plot_histograms", _M + ", g AS (SELECT gene_id, value FROM grid WHERE gene_id IN (SELECT gene_id FROM var ORDER BY gene_id LIMIT 5)), r AS (SELECT gene_id, min(value) - CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS lo, max(value) + CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS hi FROM g GROUP BY 1), b AS (SELECT gene_id, lo, hi, least(floor((value - lo) / (hi - lo) * 30), 29)::INT AS bin FROM g JOIN r USING (gene_id)) SELECT gene_id, bin, round(lo + bin * (hi - lo) / 30, 6) AS lower, count(*) AS n FROM b GROUP BY gene_id, bin, lo, hi")
def _(s, d):
    return rounded(plot_tables.histograms(frame(s, d)))


@query("plot_metric_correlation", "WITH m AS (SELECT c_nationkey, avg(c_acctbal)::DOUBLE AS x, avg(c_custkey)::DOUBLE AS y FROM customer GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM m) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM r")
def _(s, d):
    m = t(s, d, "customer").groupBy("c_nationkey").agg(F.avg(F.col("c_acctbal").cast("double")).alias("x"), F.avg("c_custkey").alias("y"))
    return rounded(plot_tables.metric_correlation(m, "x", "y"))


@query("plot_ma", _MO + " SELECT gene_id, round((m1 + m2) / 2, 6) AS mean, round(log2((m1 + 0.01) / (m2 + 0.01)), 6) AS log2fc FROM p")
def _(s, d):
    w = tests_de.welch(frame(s, d), "condition", "pos", "neg").select("gene_id", ((F.col("mean1") + F.col("mean2")) / 2).alias("m"), tests_de.log2fc(F.col("mean1"), F.col("mean2"), 0.01).alias("log2fc"))
    return rounded(plot_tables.ma_table(w, "m"))


@query("plot_metric_rows", "SELECT n_name AS method, 'n_nationkey' AS metric, n_nationkey::DOUBLE AS value FROM nation UNION ALL SELECT n_name, 'n_regionkey', n_regionkey::DOUBLE FROM nation")
def _(s, d):
    return plot_tables.metric_rows(t(s, d, "nation").select(F.col("n_name").alias("method"), "n_nationkey", "n_regionkey"))


@query("plot_benchmark_bars", "SELECT (row_number() OVER (ORDER BY n_regionkey DESC, n_name))::INT AS position, n_name AS method, n_regionkey AS ari, n_nationkey AS ami FROM nation")
def _(s, d):
    return plot_tables.benchmark_bars(t(s, d, "nation").select(F.col("n_name").alias("method"), F.col("n_regionkey").alias("ari"), F.col("n_nationkey").alias("ami")))


@query("plot_model_by_space", "SELECT model, " + ", ".join(f"round(avg(q) FILTER (WHERE space = '{v}'), 6) AS \"{v}_mean\", round(stddev_samp(q) FILTER (WHERE space = '{v}'), 6) AS \"{v}_sd\", round(stddev_samp(q) FILTER (WHERE space = '{v}') / sqrt(count(*) FILTER (WHERE space = '{v}')), 6) AS \"{v}_se\"" for v in "FO") + " FROM (SELECT l_returnflag AS model, l_linestatus AS space, l_quantity::DOUBLE AS q FROM lineitem) GROUP BY 1")
def _(s, d):
    li = t(s, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("space"), F.col("l_quantity").cast("double").alias("accuracy"))
    return rounded(plot_tables.model_by_space(li, spaces=["F", "O"]))


@query("plot_compare_bases", _E + " SELECT cell_id, round(vec[1], 6) AS c1, round(vec[2], 6) AS c2, label AS colour, 'a' AS basis FROM e UNION ALL SELECT cell_id, round(vec[3], 6), round(vec[4], 6), label, 'b' FROM e")
def _(s, d):
    p = points(s, d)
    f = CellFrame(p, p.select("cell_id", "label"), p, {"a": p.select("cell_id", "vec"), "b": p.select("cell_id", F.slice("vec", 3, 2).alias("vec"))})
    return rounded(plot_tables.compare_bases(f, ["a", "b"], "label"))


# --- methods against each other ---------------------------------------------------------


def _verdicts(p: DataFrame) -> DataFrame:
    """Three methods that fail on different cells."""
    arr = F.array(*[F.struct(F.lit(f"m{k}").alias("method"), F.when(F.pmod(F.col("cell_id") + k, F.lit(k + 3)) == 0, F.lit("none")).otherwise(F.col("label")).alias("pred")) for k in (1, 2, 3)])
    return p.select("cell_id", F.explode(arr).alias("e")).select("cell_id", "e.method", "e.pred")


@query("method_pairs", _E + ", p AS (SELECT cell_id, 'm' || k AS method, (cell_id + k) % (k + 3) <> 0 AS ok FROM e CROSS JOIN (VALUES (1), (2), (3)) v(k)) SELECT x.method AS a, y.method AS b, count(*) AS n, sum((x.ok AND NOT y.ok)::INT)::BIGINT AS only_a, sum((y.ok AND NOT x.ok)::INT)::BIGINT AS only_b, round((sum((x.ok AND NOT y.ok)::INT) - sum((y.ok AND NOT x.ok)::INT))::DOUBLE / count(*), 6) AS diff FROM p x JOIN p y ON x.cell_id = y.cell_id AND x.method < y.method GROUP BY 1, 2")
def _(s, d):
    p = points(s, d)
    return rounded(comparison.method_pairs(_verdicts(p), p.select("cell_id", F.col("label").alias("true"))))


@query("nvi", _E + ", a AS (SELECT k AS resolution, cell_id, (cell_id % (k + 2)) AS c FROM e CROSS JOIN (VALUES (1), (2), (4), (8)) v(k)), s AS (SELECT resolution, lead(resolution) OVER (ORDER BY resolution) AS nx FROM (SELECT DISTINCT resolution FROM a)), c AS (SELECT x.resolution, nx, x.c AS ca, y.c AS cb, count(*)::DOUBLE AS k FROM s JOIN a x USING (resolution) JOIN a y ON y.resolution = nx AND y.cell_id = x.cell_id GROUP BY 1, 2, 3, 4), w AS (SELECT *, sum(k) OVER (PARTITION BY resolution) AS n, sum(k) OVER (PARTITION BY resolution, ca) AS ka, sum(k) OVER (PARTITION BY resolution, cb) AS kb FROM c), v AS (SELECT resolution, nx, greatest(0, sum(k / n * (ln(ka / k) + ln(kb / k)))) AS vi, max(n) AS n FROM w GROUP BY 1, 2) SELECT resolution::DOUBLE AS resolution, nx::DOUBLE AS next_resolution, round(vi, 6) AS vi, round(vi / ln(n), 6) AS nvi FROM v")
def _(s, d):
    ks = F.array(*[F.lit(k) for k in (1, 2, 4, 8)])
    a = points(s, d).select("cell_id", F.explode(ks).alias("k")).select(F.col("k").cast("double").alias("resolution"), "cell_id", (F.col("cell_id") % (F.col("k") + 2)).cast("string").alias("cluster"))
    return rounded(comparison.nvi(a))


@query("compare_classifiers")
def _(s, d):
    p = points(s, d)
    return comparison.compare_classifiers(_verdicts(p), p.select("cell_id", F.col("label").alias("true")), "permutation")


@query("bootstrap_agreement")
def _(s, d):
    return rounded(comparison.bootstrap_agreement(points(s, d), "label", "cluster", 500))


@query("hdbscan")
def _(s, d):
    return density.hdbscan(points(s, d), 5)


@query("patients_by_type")
def _(s, d):
    return density.patients_by_type(summary.pseudobulk(frame(s, d), "sample", "label", "median").select(F.col("sample").alias("patient"), "type", "gene_id", "value"))


# --- runners ------------------------------------------------------------------------------


@query("reduced_frame", _M + " SELECT cell_id, gene_id, value FROM x WHERE gene_id IN (SELECT gene_id FROM var ORDER BY gene_id DESC LIMIT 3)")
def _(s, d):
    f = frame(s, d)
    return benchmarks.reduced(f, [r[0] for r in f.var.orderBy(F.desc("gene_id")).limit(3).collect()]).x.select("cell_id", "gene_id", "value")


@query("dense_vectors", _M + " SELECT cell_id, label, (row_number() OVER (PARTITION BY cell_id ORDER BY gene_id) - 1)::INT AS j, value FROM grid JOIN obs USING (cell_id)")
def _(s, d):
    return benchmarks.vectors(frame(s, d), "label").select("cell_id", "label", F.posexplode("vec").alias("j", "value"))


@query("bio_conservation", _E + ", m AS (SELECT a.cell_id, a.label AS own, b.label, sum(list_distance(a.vec, b.vec)) AS s, count(*) AS n FROM e a JOIN e b ON a.cell_id <> b.cell_id GROUP BY 1, 2, 3), o AS (SELECT e.cell_id, (SELECT count(*) FROM e f WHERE f.label = e.label) AS size FROM e), w AS (SELECT cell_id, max(CASE WHEN label = own THEN s / n END) AS a, min(CASE WHEN label <> own THEN s / n END) AS b FROM m GROUP BY 1) SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS bio_conservation FROM w JOIN o USING (cell_id)")
def _(s, d):
    return s.createDataFrame([(round(round(benchmarks.bio_conservation(points(s, d)), 12), 6),)], "bio_conservation double")


@query("benchmark_de")
def _(s, d):
    return benchmarks.benchmark_de(frame(s, d), "condition", "neg", "pos")


@query("benchmark_batch")
def _(s, d):
    return rounded(benchmarks.benchmark_batch(points(s, d)))


@query("validate_reduced")
def _(s, d):
    f = frame(s, d)
    return rounded(benchmarks.validate_reduced(f, [r[0] for r in f.var.orderBy("gene_id").limit(10).collect()], "label", "LDA"))


# --- streaming extension --------------------------------------------------------------


@query("event_counts", "SELECT user_id AS cell_id, event_type AS gene_id, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2")
def _(s, d):
    return t(s, d, "events").groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
