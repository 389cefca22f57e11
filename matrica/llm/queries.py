"""The registered queries of the corpus operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrica.llm import bpe_transducer, decontaminate, licenses, line_crf, quality_rules, site_templates, token_orc, url_filter, warc, weighted_dedup
from matrica.llm._shared import fresh_path, materialize, table, tokenizer_file


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs with the labels of the document they show (the number in the
    path); low quality or toxic ones are to be blocked."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("url", F.try_to_number(F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})(?:[./?#]|$)", 1), F.lit("9" * 18)).cast("long").alias("doc"))
    marked = labels.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("block"))
    return shown.join(marked, shown["doc"] == marked["doc_id"]).select("url", "block")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.fit_labels(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score_documents(docs, model)
    return scored.select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_orc.token_digests(spark, path)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_transducer.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_texts(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_decontamination": op3_decontamination,
        "op4_quality_rules": op4_quality_rules,
        "op5_token_output": op5_token_output,
        "op6_license_scans": op6_license_scans,
        "op7_warc": op7_warc,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_html_extraction": op9_html_extraction,
        "op10_near_dedup": op10_near_dedup,
        "pipeline": pipeline,
    }


# Pages, documents and texts as stages of a pipeline keep the documents' columns.


def stage_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.keep_good(docs, line_crf.fit_labels(docs, table(spark, sf_dir, "labels")))


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_by_rules(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weighted_dedup.drop_near_duplicates(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_transducer.encode_documents(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(DISTINCT s) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared::DOUBLE / n_item, 6) AS containment FROM h JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""

_OP4 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM t),
g AS (SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM a),
u AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM u) WHERE c > 1),
k AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
c AS (SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words FROM g LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
s1 AS (SELECT sum(w) AS w, sum(w * p) AS wp, sum(w * p * p) AS wpp, sum(w * w) AS ww, sum(w / n) AS wn, sum(w * w / n) AS wwn FROM (SELECT n, n::DOUBLE AS w, bad / n AS p FROM h)),
m1 AS (SELECT wp / w AS m, wpp - wp * wp / w AS s, wn - wwn / w AS a, w - ww / w AS b FROM s1),
r1 AS (SELECT m, CASE WHEN m * (1 - m) <= 0 OR b - a <= 1e-12 THEN 0.0 ELSE least(1.0, greatest(0.0, (s / (m * (1 - m)) - a) / (b - a))) END AS rho FROM m1),
s2 AS (SELECT sum(w) AS w, sum(w * p) AS wp, sum(w * p * p) AS wpp, sum(w * w) AS ww, sum(w / n) AS wn, sum(w * w / n) AS wwn FROM (SELECT n, n / (1 + (n - 1) * rho) AS w, bad / n AS p FROM h, r1)),
m2 AS (SELECT wp / w AS m, wpp - wp * wp / w AS s, wn - wwn / w AS a, w - ww / w AS b FROM s2),
r2 AS (SELECT m, CASE WHEN m * (1 - m) <= 0 OR b - a <= 1e-12 THEN 0.0 ELSE least(1.0, greatest(0.0, (s / (m * (1 - m)) - a) / (b - a))) END AS rho FROM m2),
p AS (SELECT m, CASE WHEN rho > 0 THEN least(100.0, 1 / rho - 1) ELSE 100.0 END AS k FROM r2),
x AS (SELECT source FROM h, p WHERE (bad + p.m * p.k) / (n + p.k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM x WHERE x.source IS NOT DISTINCT FROM f.source) AS kept FROM f
"""


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in licenses.KNOWN.items())
    sql = [
        f"WITH known(k, id) AS (VALUES {known})",
        f"s AS (SELECT doc_id, unnest(regexp_split_to_array(text, {quote(licenses.CUT)})) AS s, generate_subscripts(regexp_split_to_array(text, {quote(licenses.CUT)}), 1) AS i FROM documents)",
        "i AS (SELECT doc_id, i, id FROM s JOIN known ON k = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))",
        "o AS (SELECT doc_id, i, id FROM (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM i) WHERE before IS DISTINCT FROM id)",
        "r0 AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) AS sentence_ids, string_agg(',' || id || ',', '' ORDER BY i) AS l, CAST([] AS VARCHAR[]) AS f FROM o GROUP BY doc_id)",
    ]
    for k, (name, seq) in enumerate(licenses.RULES):
        run = quote("," + ",,".join(seq) + ",")
        sql.append(f"r{k + 1} AS (SELECT doc_id, sentence_ids, replace(l, {run}, '|') AS l, CASE WHEN contains(l, {run}) AND NOT list_contains(f, {quote(name)}) THEN list_append(f, {quote(name)}) ELSE f END AS f FROM r{k})")
    return ",\n".join(sql) + f"\nSELECT d.doc_id, coalesce(r.sentence_ids, '') AS sentence_ids, coalesce(array_to_string(r.f, ','), '') AS licenses FROM documents d LEFT JOIN r{len(licenses.RULES)} r USING (doc_id)"


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": _OP3, "op4_quality_rules": _OP4, "op6_license_scans": _license_sql()}
