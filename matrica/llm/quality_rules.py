"""Quality rules by document and by host.

Per document, in one expression over the whole text: word and symbol counts,
repeated lines, and the words that lie in five-word windows occurring twice or
more.  Per host (a URL's host or a source name): the share of documents that
fail a rule, shrunk towards all hosts by a beta prior fitted to the hosts'
rates by weighted moments; hosts whose shrunk rate is above a threshold lose
their other documents too.  The prior is worth ``MAX_STRENGTH`` documents at
most, so a host's own documents always tell in the end.

Everything is DataFrame functions.  The text never leaves its row: windows are
64-bit hashes sorted inside the row, and only counts are written, grouped and
joined.  The join is from documents to one row per host, so a host with a
third of all documents is split by the adaptive skew join.

Defined cases: a null text has no words and fails; a null host counts as one
host of its own; repeated rows count each; extra columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.llm._shared import materialize

_SPACE = " \t\n\x0b\x0c\r"
#: Ten words at least; a fifth of them repeated at most.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: The prior counts as this many documents at most, also where hosts do not differ at all.
MAX_STRENGTH = 100.0
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{_SPACE}]+"), lambda w: w != "")


def _repeated(words: Column, n: int = 5) -> Column:
    """Words covered by ``n``-word windows that occur at least twice."""
    starts = F.sequence(F.lit(0), F.size(words) - n)
    # Sorted by hash and place, equal windows are neighbours.
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda x: x["i"]))

        def count(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b)

        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(_bind(F.sort_array(marked), places), count))

    return F.when(F.size(words) <= n, F.lit(0)).otherwise(_bind(hashes, covered)).cast("long")


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """``(id, _host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``."""
    host = F.col("source") if host is None else host
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{_SPACE}]"))
    counted = docs.select(
        F.col(id_col),
        host.cast("string").alias("_host"),
        F.transform(
            F.array(F.struct(words_of(F.col(text_col)).alias("w"), lines.alias("l"))),
            lambda x: F.struct(
                F.size(x["w"]).cast("long").alias("n_words"),
                F.aggregate(x["w"], F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
                (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
                _repeated(x["w"]).alias("n_repeat_words"),
            ),
        )[0].alias("_c"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    c = counted.select(id_col, "_host", "_c.n_words", "_c.word_chars", "n_symbols", "_c.n_dup_lines", "_c.n_repeat_words")
    return c.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def base_verdict(text: Column) -> Column:
    """Whether a text fails the word rules; the other counts are not computed."""

    def failed(w: Column) -> Column:
        n = F.size(w)
        return (n < MIN_WORDS) | (100 * _repeated(w) > MAX_REPEAT_PERCENT * n)

    return _bind(words_of(text), failed)


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(_host, n, failed, rate, host_failed)`` from document counts.

    The prior's mean and overdispersion ``rho`` come from weighted moments of
    the hosts' rates (Kleinman 1973), in two rounds: hosts weigh by their
    documents first, then by ``n / (1 + (n - 1) rho)``, so neither a host with a
    third of all documents nor many tiny ones decide alone.  Summary rows of
    fixed size go through the driver.
    """
    hosts = counts.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = materialize(hosts, "host-counts")
    mean, rho = 0.0, 0.0
    for turn in range(2):
        w = F.col("n") / (1 + (F.col("n") - 1) * F.lit(rho)) if turn else F.col("n").cast("double")
        p = F.col("failed") / F.col("n")
        s = hosts.select(w.alias("w"), p.alias("p"), "n").agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("p")).alias("wp"), F.sum(F.col("w") * F.col("p") * F.col("p")).alias("wpp"),
            F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") / F.col("n")).alias("wn"), F.sum(F.col("w") * F.col("w") / F.col("n")).alias("wwn"),
        ).first()
        mean, rho = weighted_prior(s["w"], s["wp"], s["wpp"], s["ww"], s["wn"], s["wwn"]) if s["w"] else (0.0, 0.0)
    strength = min(MAX_STRENGTH, 1 / rho - 1) if rho > 0 else MAX_STRENGTH
    shrunk = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", F.col("rate") > max_rate)


def weighted_prior(w: float, wp: float, wpp: float, ww: float, wn: float, wwn: float) -> tuple[float, float]:
    """Mean and overdispersion (0 to 1) from weighted sums over hosts.

    With weights w, the expected weighted square deviation of rates p is
    ``m (1 - m) (a + rho (b - a))`` with ``a = sum w/n - sum w^2/n / sum w`` and
    ``b = sum w - sum w^2 / sum w``; it is solved for rho.
    """
    mean = wp / w
    spread, a, b = wpp - wp * wp / w, wn - wwn / w, w - ww / w
    if mean * (1 - mean) <= 0 or b - a <= 1e-12:
        return mean, 0.0
    return mean, min(1.0, max(0.0, (spread / (mean * (1 - mean)) - a) / (b - a)))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts per document with ``base_failed`` and ``kept``."""
    counts = materialize(rule_counts(docs, id_col, text_col, host), "rule-counts")
    bad = host_verdicts(counts, max_rate).where("host_failed").select(F.col("_host").alias("_bad"), F.lit(True).alias("_hit"))
    out = counts.join(bad, counts["_host"].eqNullSafe(bad["_bad"]), "left")
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("_hit").isNull()).alias("kept"))


def keep_by_rules(docs: DataFrame, text_col: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows, with all their columns, that the rules and their host keep.

    Texts are read once: the base verdict is written beside the rows, hosts are
    summed from it, and bad hosts are taken out by an anti join.
    """
    scored = materialize(docs.withColumn("_failed", base_verdict(F.col(text_col))), "ruled")
    bad = host_verdicts(scored.select(F.col(host).cast("string").alias("_host"), F.col("_failed").alias("base_failed")), max_rate).where("host_failed").select(F.col("_host").alias("_bad"))
    good = scored.where(~F.col("_failed"))
    return good.join(bad, good[host].cast("string").eqNullSafe(bad["_bad"]), "left_anti").drop("_failed")
