"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document's base rules are counted from its whole text. Rule failures are
then summed by domain (the `source` of a document), and each domain's failure
rate is shrunk towards an empirical beta prior, fitted to all domains by the
method of moments: its posterior is a beta distribution too. Documents of a
domain go, whatever their own counts, if its rate is a multiple of what is
usual, beyond doubt: if the posterior's mean less some standard deviations is
above that multiple of the prior's mean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .session import checkpointed

#: Words are runs of anything but these.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: base rules. host_multiple, host_deviations: a
    domain goes if its posterior failure rate, less so many standard deviations, is
    above so many times the prior's mean. max_strength: bound of the prior's weight in
    documents, for domains that hardly differ."""

    min_words: int = 20
    max_repeat_percent: int = 30
    host_multiple: float = 2.0
    host_deviations: float = 3.0
    max_strength: float = 1000.0


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once; a plain projection would put its expression into every lambda call."""
    return F.transform(F.array(value), use)[0]


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(order: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    # a window covers its words up to the next repeated window's start
    return F.aggregate(
        _let(ordered, again),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def _of_words(w: Column) -> Column:
    # element by element: slice() would copy the whole array for each window
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    hashes = F.when(F.size(w) > WINDOW, _let(F.transform(w, lambda x: F.xxhash64(x)), windows)).otherwise(F.array().cast("array<bigint>"))
    repeats = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeated(h)))
    return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeats.cast("long").alias("n_repeat_words"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        _let(F.array_remove(F.split(text, BLANKS), ""), _of_words).alias("of_words"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "source", "of_words.*", "n_symbols", "n_dup_lines")


def host_verdicts(failures: DataFrame, rules: Rules) -> DataFrame:
    """source, host_rate, host_failed from (source, base_failed); a null source has no host."""
    hosts = failures.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    fit = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("k").alias("ks"), F.sum("n").alias("ns"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1.0 / F.col("n")).alias("inv"))
    overall = F.col("ks") / F.col("ns")
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.col("var") - spread * F.col("inv")
    strength = F.when((F.col("hosts") < 2) | (between <= 0) | between.isNull(), F.lit(rules.max_strength)).otherwise(F.least(F.lit(rules.max_strength), F.greatest(F.lit(1.0), spread / between - 1)))
    fit = fit.select(overall.alias("prior"), strength.alias("strength"))
    shrunk = (F.col("k") + F.col("prior") * F.col("strength")) / (F.col("n") + F.col("strength"))
    deviation = F.sqrt(shrunk * (1 - shrunk) / (F.col("n") + F.col("strength") + 1))
    failed = shrunk - rules.host_deviations * deviation > rules.host_multiple * F.col("prior")
    return hosts.crossJoin(F.broadcast(fit)).select("source", shrunk.alias("host_rate"), failed.alias("host_failed"))  # fit is one row


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept.

    A null text is empty and fails; a document without a source is judged on
    its own rules; repeated rows are counted each, equal rates get equal
    verdicts; long texts are measured whole; an empty table gives no rows. Columns other than doc_id, text and source are not read.
    """
    counted = measures(docs).withColumn(
        "base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    )
    counted = checkpointed(counted)  # narrow; the texts are read once
    hosts = checkpointed(host_verdicts(counted, rules).withColumnRenamed("source", "host"))
    return counted.join(hosts, counted["source"] == hosts["host"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
    )


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, i - coalesce(p, -8))) AS k FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) AS hosts, sum(k) / sum(n) AS prior, avg(k / n) AS mean, var_samp(k / n) AS var, avg(1.0 / n) AS inv FROM h),
p AS (SELECT prior, CASE WHEN hosts < 2 OR var - mean * (1 - mean) * inv <= 0 OR var IS NULL THEN 1000.0
        ELSE least(1000.0, greatest(1.0, mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1)) END AS strength FROM m),
r2 AS (SELECT source, n, strength, prior, (k + prior * strength) / (n + strength) AS host_rate FROM h, p),
v AS (SELECT source, host_rate, host_rate - 3 * sqrt(host_rate * (1 - host_rate) / (n + strength + 1)) > 2 * prior AS host_failed FROM r2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) AS host_rate,
  NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM f LEFT JOIN v ON f.source = v.source
"""
