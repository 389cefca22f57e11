"""URL filter: fixed host rules, then rules mined from labelled URLs.

A URL gives a set of tokens: its scheme, the labels of its host, the words of
its path, and query keys; numbers are left out.  FP-growth over the labelled URLs' token sets, each with its label as an
item, gives rules "these tokens imply block", pruned by support, confidence
and lift, and by dropping a rule when a subset of its tokens is a rule too.
Support is a number of URLs, so a bad host is found however many others there
are; the lift asked for is never more than half of what any rule could reach
above 1, so rules are found also where most labelled URLs are bad.
URLs are matched by an inverted index: each rule is filed under its rarest
token, a URL looks up its own tokens only, and the rule's other tokens are
checked in the row.

Fixed rules ``(verdict, host/path)`` fit a host, all its subdomains and paths
that start with theirs; the longest wins and stands above mined rules.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and only the tokens left, none; URLs that nothing matches are allowed;
repeated URLs are judged each; without labels of both kinds, or without any
rule that survives, no URL is blocked by mining; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.llm._shared import materialize

FIXED = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
MIN_CONFIDENCE, MIN_LIFT = 0.6, 1.5
#: Labelled URLs a rule must hold on at least, whatever their share.
MIN_COUNT = 20
#: Rules that may be broadcast; more are joined by shuffle.
BROADCAST_RULES = 20_000
_BLOCK = "=block"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # the last, longest one is asked first
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, none of them only digits."""
    host, path = host_of(url), path_of(url)
    text = F.coalesce(url, F.lit(""))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    labels = F.split(host, r"\.")
    words = F.split(F.lower(path), r"[^\p{L}\p{N}]+")
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda k: F.concat(F.lit("?"), k))
    tag = lambda c, t: F.transform(c, lambda x: F.concat(F.lit(t), x))
    every = F.concat(tag(F.array(scheme), "s:"), tag(labels, "h:"), tag(words, "p:"), keys)
    known = F.filter(every, lambda t: ~t.rlike(r"^[a-z]?:?[0-9]*$"))
    return F.when(text.contains("://"), F.array_distinct(known)).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, url_col: str, block_col: str, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """``(tokens array, support, confidence, lift)``: rules whose consequent is block.

    Counting is distributed (FP-growth); a rule must hold on ``min_count`` of
    the labelled URLs at least, ``min_confidence`` of those with its tokens.
    """
    from pyspark.ml.fpm import FPGrowth

    block = F.coalesce(F.col(block_col).cast("boolean"), F.lit(False))
    items = labelled.select(F.concat(url_tokens(F.col(url_col)), F.when(block, F.array(F.lit(_BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    items = materialize(items.where(F.size("items") > 0), "url-items")
    shape = "tokens array<string>, support double, confidence double, lift double"
    seen = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("items", _BLOCK)).alias("bad")).first()
    # No rule can hold on more URLs than there are bad ones; one kind of label alone tells nothing.
    if seen["bad"] < min_count or seen["bad"] == seen["n"]:
        return labelled.sparkSession.createDataFrame([], shape)
    # A hair below, so that the product with n does not round up past the count.
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 1e-6) / seen["n"], minConfidence=min_confidence).fit(items)
    lift = min(min_lift, (1 + seen["n"] / seen["bad"]) / 2)
    rules = model.associationRules.where((F.element_at("consequent", 1) == _BLOCK) & (F.col("lift") >= lift))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "support", "confidence", "lift"), "url-rules")
    # A rule with a subset that is a rule too adds nothing to block: found by token, not by pairs of rules.
    index = rules.select(F.col("tokens").alias("sub"), F.explode("tokens").alias("t"))
    shared = rules.select("tokens", F.explode("tokens").alias("t")).join(index, "t").where(F.size("sub") < F.size("tokens"))
    wider = shared.groupBy("tokens", "sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("sub")).select("tokens").distinct()
    return materialize(rules.join(wider, "tokens", "left_anti"), "url-rules")


def matched_rules(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """``(id, n_rules, confidence)`` of the URLs that at least one mined rule matches."""
    tokens = urls.select(F.col(id_col).alias("_id"), url_tokens(F.col(url_col)).alias("_t"))
    n = rules.count()
    if not n:
        return tokens.select("_id", F.lit(0).cast("long").alias("n_rules"), F.lit(None).cast("double").alias("confidence")).limit(0)
    hint = F.broadcast if n <= BROADCAST_RULES else (lambda x: x)
    filed = rules.select("tokens", "confidence", F.explode("tokens").alias("t"))
    often = filed.groupBy("t").agg(F.count(F.lit(1)).alias("uses"))
    rarest = filed.join(often, "t").groupBy("tokens", "confidence").agg(F.min(F.struct("uses", "t"))["t"].alias("key"))
    hits = tokens.select("_id", "_t", F.explode("_t").alias("key")).join(hint(rarest), "key").where(F.size(F.array_except("tokens", "_t")) == 0)
    return hits.groupBy("_id").agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence"))


def judge_urls(urls: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str]] = FIXED, id_col: str = "page_id", url_col: str = "url", label_url: str = "url", block_col: str = "block", **mining) -> DataFrame:
    """``(id, host, path, rule, verdict, n_rules, confidence)`` for every URL."""
    rules = mine_rules(labelled, label_url, block_col, **mining)
    hits = matched_rules(urls, rules, id_col, url_col)
    name, kind = fixed_rule(F.col("host"), F.col("path"), fixed)
    base = urls.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.withColumn("rule", name).withColumn("_kind", kind)
    out = base.join(hits, base[id_col] == hits["_id"], "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("_kind", F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"), "confidence")
