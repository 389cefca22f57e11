"""Benchmark decontamination: which documents contain which test items.

Containment search by MinHash sketches whose size depends on the item's size.
Items are partitioned by their number of distinct five-word shingles, in
classes that double.  An item of class ``c`` keeps its ``k`` smallest shingle
hashes, ``k`` being one more than the shingles that the largest item of the
class may lack at the containment asked for.  A document that contains enough
of the item therefore has all but so many of the sketch's hashes, which for an
item smaller than its class's largest is more than one: ``need`` of them, so the
search misses nothing; of a document, only hashes below the largest sketch
hash are looked up.  Each candidate pair is then verified on the shingles
themselves: distinct shingles of the item found in the document over all of
the item's, by a join on (document, shingle) that only the pair's own
shingles enter.

All steps are DataFrame functions.  Sketches are broadcast only while their
counted rows stay under a bound; beyond it the join shuffles by hash, which
spreads any single document over all tasks.

Words are runs of letters and digits, lower-cased.  Defined cases: null texts
and texts under five words have no shingle and never match; repeated items
each match; repeated document ids count as one document; an empty benchmark
or an empty corpus gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.llm._shared import materialize

#: Sketch rows that may be broadcast (24 bytes each).
BROADCAST_ROWS = 200_000
NGRAM, THRESHOLD = 5, 0.8


def norm_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, n: int = NGRAM) -> Column:
    """64-bit hashes of the windows of ``n`` words, in order; empty if there is none."""
    none = F.array().cast("array<bigint>")
    return _bind(norm_words(text), lambda w: F.when(F.size(w) < n, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))))


def shingle_strings(text: Column, n: int = NGRAM) -> Column:
    none = F.array().cast("array<string>")
    return _bind(norm_words(text), lambda w: F.when(F.size(w) < n, none).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))))


def item_sketches(items: DataFrame, item_id: str, text_col: str, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``(item, n_item, size_class, need, hash)``: per item the smallest hashes its class needs, and how many of them a document must have."""
    full = items.select(F.col(item_id).alias("_item"), F.sort_array(F.array_distinct(shingle_hashes(F.col(text_col), n))).alias("_h"))
    sized = full.withColumn("_n", F.size("_h")).where("_n > 0").withColumn("_class", F.floor(F.log2(F.col("_n"))).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("_class") + 1) - 1
    k = F.floor(largest * (1 - threshold) + 1e-9).cast("int") + 1
    may_lack = F.floor(F.col("_n") * (1 - threshold) + 1e-9).cast("int")
    need = F.greatest(F.lit(1), F.least(k, F.col("_n")) - may_lack)
    return sized.select("_item", F.col("_n").cast("long").alias("n_item"), F.col("_class").alias("size_class"), need.alias("need"), F.explode(F.slice("_h", 1, k)).alias("_hash"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, n: int = NGRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(id, item, n_shared, n_item, containment)`` for every document and item at or over the threshold."""
    sketch = materialize(item_sketches(items, item_id, item_text, threshold, n), "sketches")
    size = sketch.agg(F.count(F.lit(1)).alias("n"), F.max("_hash").alias("top")).first()
    small = size["n"] <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    top = F.lit(size["top"] if size["top"] is not None else -(2**63)).cast("long")

    found = docs.select(F.col(id_col).alias("_doc"), F.explode(F.filter(shingle_hashes(F.col(text_col), n), lambda h: h <= top)).alias("_hash"))
    met = found.join(hint(sketch.select("_hash", "_item", "need")), "_hash").select("_doc", "_item", "need", "_hash").distinct()
    pairs = met.groupBy("_doc", "_item").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("_doc", "_item")
    pairs = materialize(pairs, "candidates")

    wanted = pairs.select("_doc").distinct()
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(wanted, "_doc", "left_semi")
    of_doc = texts.select("_doc", F.explode(shingle_strings(F.col("_text"), n)).alias("_s")).distinct()
    of_item = items.select(F.col(item_id).alias("_item"), shingle_strings(F.col(item_text), n).alias("_all"))
    of_item = of_item.where(F.size("_all") > 0).select("_item", F.size("_all").cast("long").alias("n_item"), F.explode("_all").alias("_s")).distinct()
    shingles = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("n")).first()["n"]
    hint = F.broadcast if shingles <= 40 * broadcast_rows else (lambda x: x)
    # Only shingles that some item has go on to the join on (document, shingle).
    of_doc = of_doc.join(hint(of_item.select("_s").distinct()), "_s", "left_semi")
    asked = pairs.join(hint(of_item), "_item")
    hits = asked.join(of_doc, ["_doc", "_s"]).select("_doc", "_item", "n_item")
    shared = hits.groupBy("_doc", "_item").agg(F.max("n_item").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    out = shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)
    return out.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_id), "n_shared", "n_item", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Documents that contain no item."""
    key = kw.get("id_col", "doc_id")
    hits = contaminated(docs, items, **kw).select(F.col(key).alias("_hit")).distinct()
    return docs.join(hits, docs[key] == hits["_hit"], "left_anti")


def sketch_size(n_shingles: int, threshold: float = THRESHOLD) -> int:
    """Hashes an item of so many shingles keeps."""
    largest = 2 ** (int(math.log2(n_shingles)) + 1) - 1
    return int(largest * (1 - threshold) + 1e-9) + 1
