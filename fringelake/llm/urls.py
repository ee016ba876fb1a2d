"""URL filters: explicit rules, then host word segmentation and naive Bayes.

Concatenated host names are split into words by a Viterbi search under a
unigram model counted on the pages themselves; a multinomial naive Bayes over
host words and path tokens decides the urls that no rule fits. Segmentation
works on distinct host labels only, whose substrings meet the word counts in a
join, so neither the vocabulary nor the hosts have to fit anywhere at once.

The classes are fitted to data: urls that the rules block against all others,
without the words that the rules themselves look at (in the hosts and paths that
they name), so that a site's other pages and its sister sites follow. Hosts of
one fold are left out, and the score is tried on them: where it doesn't tell
hosts with a url that a rule blocks from hosts without, the classifier blocks nothing. Counts are kept by
token hash in a bounded number of buckets. Labelled example phrases, a
parameter, add their own weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .session import checkpointed
from .textkit import column

#: Rules of the query: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

@dataclass(frozen=True)
class Filter:
    """blocked, allowed: labelled example phrases; prior: P(block) before any token; smooth: Laplace count of the
    examples; shrink: pseudo count that draws a token's share of blocked urls to the overall one; bits: of the token
    buckets; folds: hosts with crc32 modulo it 0 are not learnt from; longest: letters of a word
    at most; example_weight: count of each example word in the unigram model; deviations: of
    least_score."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    blocked: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    prior: float = 0.3
    smooth: float = 0.5
    shrink: float = 10.0
    bits: int = 18
    folds: int = 5
    longest: int = 20
    example_weight: int = 50
    deviations: float = 5.0


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, _PARTS, 2).alias("path"),
    )


def _rule(rules: tuple[tuple[str, str, str], ...], give: int) -> Column:
    """The longest rule that fits (give 0), its verdict (give 1)."""
    out = F.when(F.lit(False), F.lit(""))
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = out.when(fits, F.lit((host + path, verdict)[give]))
    return out


def segment(label: str, counts: dict[str, int], total: float, longest: int = 20) -> list[str]:
    """Most likely words of `label`; an unknown piece costs as much as its letters."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            word = label[start:end]
            n = counts.get(word, 0)
            cost = -math.log(n / total) if n else math.log(total) + 3.2 * len(word)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


Counts = dict[int, tuple[int, int]]


class Bayes:
    """Multinomial naive Bayes over tokens, from examples and from counts (bucket: allowed, blocked); unknown tokens say nothing."""

    def __init__(self, f: Filter, counts: Counts):
        examples = [Counter(t for x in texts for t in x.split()) for texts in (f.allowed, f.blocked)]
        seen = set(examples[0]) | set(examples[1])
        size = [sum(c.values()) + f.smooth * len(seen) for c in examples]
        self.weight = {t: math.log((examples[1][t] + f.smooth) / size[1]) - math.log((examples[0][t] + f.smooth) / size[0]) for t in seen}
        self.bias = math.log(f.prior / (1 - f.prior))
        total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
        share = (total[1] + 0.5) / (sum(total) + 1)
        self.learnt = {b: math.log((y + f.shrink * share) / (x + f.shrink * (1 - share))) - math.log(share / (1 - share)) for b, (x, y) in counts.items()}
        self.buckets = 1 << f.bits

    def score(self, tokens: list[str]) -> float:
        return self.bias + sum(self.weight.get(t, 0.0) + self.learnt.get(bucket(t, self.buckets), 0.0) for t in tokens)


def bucket(token: str, buckets: int) -> int:
    """As Spark's xxhash64 has it."""
    return xxhash.xxh64_intdigest(token.encode(), 42) & (buckets - 1)


def word_counts(pages: DataFrame, f: Filter) -> DataFrame:
    """(word, n) of lower-case ASCII words in all pages' visible text, with the examples' words added."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    visible = F.regexp_replace(html, r"<[^<>]*>", " ")
    found = pages.select(F.explode(F.split(F.lower(visible), r"[^\p{L}]+")).alias("word")).where(F.col("word").rlike(f"^[a-z]{{2,{f.longest}}}$"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = Counter(w for text in f.blocked + f.allowed for w in text.split())
    session = pages.sparkSession
    examples = session.createDataFrame([(w, n * f.example_weight) for w, n in sorted(own.items())], "word string, n long")
    return counted.unionByName(examples).groupBy("word").agg(F.sum("n").alias("n"))


def labels_of(host: Column) -> Column:
    return F.filter(F.split(host, r"[^a-z]+"), lambda x: x != "")


#: A label in one of so many hosts is common.
COMMON = 1000
#: Starts of a long label whose substrings are sent at once.
STARTS = 50_000


def _pieces(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """(id, word): every substring of a label that could be a word; a label of n letters has `longest` * n at most."""
    for batch in batches:
        ids, words = [], []
        for own, label in zip(column(batch, "id").to_pylist(), column(batch, "label").to_pylist()):
            for at in range(0, len(label), STARTS):
                some = {label[k : k + n] for k in range(at, min(at + STARTS, len(label))) for n in range(1, min(longest, len(label) - k) + 1)}
                ids += [own] * len(some)
                words += sorted(some)
                if len(ids) > STARTS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(words, pa.string())], ["id", "word"])
                    ids, words = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(words, pa.string())], ["id", "word"])


def segmented(hosts: DataFrame, counts: DataFrame, f: Filter) -> DataFrame:
    """(label, words) of each distinct label of the hosts."""
    labels = checkpointed(hosts.select(F.explode(labels_of(F.col("host"))).alias("label")).distinct().withColumn("id", F.unhex(F.sha2("label", 256))))
    # the substrings go by the label's digest to meet their counts; both sides are dealt by the word, of which a label has each once
    pieces = labels.mapInArrow(lambda it: _pieces(it, f.longest), "id binary, word string")
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    known = pieces.join(counts, "word").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("counts"))
    longest = f.longest

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = column(batch, "label").to_pylist()
            words = [segment(name, dict(own or []), total, longest) for name, own in zip(names, column(batch, "counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(known, "id", "left").select("label", "counts").mapInArrow(split, "label string, words array<string>")


def learnt_counts(parts: DataFrame, labels: DataFrame, f: Filter) -> Counts:
    """Tokens of the urls by bucket, blocked by a rule or not: 2 ** (bits + 1) numbers at most."""
    known = parts.where(~F.col("held_out")).select("host", "path", F.coalesce(F.col("ruled") == "block", F.lit(False)).alias("bad"))
    hosts = known.groupBy("host", "bad").agg(F.count(F.lit(1)).alias("n"))
    words = hosts.select("bad", "n", F.explode(labels_of(F.col("host"))).alias("label")).groupBy("label", "bad").agg(F.sum("n").alias("n")).join(labels, "label")
    words = words.select("bad", "n", F.explode("words").alias("token"))
    tokens = known.select("bad", F.lit(1).cast("long").alias("n"), F.explode(F.regexp_extract_all(F.lower("path"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    at = F.xxhash64("token").bitwiseAND(F.lit((1 << f.bits) - 1)).alias("bucket")
    ruled = sorted({t for host, path, _ in f.rules for t in re.findall("[a-z]+", f"{host} {path}".lower())})
    every = words.unionByName(tokens).where(~F.col("token").isin(ruled))
    rows = every.groupBy(at).agg(F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("allowed"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("blocked")).collect()
    return {r["bucket"]: (r["allowed"], r["blocked"]) for r in rows}


def host_scores(hosts: DataFrame, labels: DataFrame, f: Filter, counts: Counts) -> DataFrame:
    """(host, host_score, host_words): naive Bayes weight of each distinct host's words, each as often as it stands there."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Bayes(f, counts)
        for batch in batches:
            scores = [model.score(w) - model.bias for w in column(batch, "words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    scored = labels.mapInArrow(score, "label string, words array<string>, score double")
    every = hosts.select("host", F.posexplode(labels_of(F.col("host"))).alias("at", "label"))
    # labels such as com stand in most hosts: those with a thousandth of all, a thousand at most, go to the hosts
    often = every.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = often.agg(F.sum("n")).first()[0] or 0
    scored = checkpointed(scored.join(often, "label"))
    head = F.broadcast(scored.where(F.col("n") * COMMON >= total).drop("n"))
    of_host = every.join(head, "label").unionByName(every.join(head.select("label"), "label", "left_anti").join(scored.drop("n"), "label"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: F.array_join(x["words"], " "))
    return of_host.groupBy("host").agg(F.sum("score").alias("host_score"), F.array_join(words, " ").alias("host_words"))


def least_score(scored: DataFrame, f: Filter) -> float:
    """Zero, where block is as likely as allow, if that tells hosts with a url that a rule blocks from hosts without; else infinite.

    It does if of the held-out urls above zero so many fewer are of hosts without than of all held-out
    urls that chance is f.deviations standard deviations away. With example phrases zero is taken as it is.
    """
    if f.blocked or f.allowed:
        return 0.0
    above, fine = F.col("score") > 0, ~F.col("bad_host")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    every, spared, n, low = scored.where("held_out").agg(F.count(F.lit(1)), count(fine), count(above), count(above & fine)).first()
    share = spared / every if every else 0.0
    spread = math.sqrt(n * share * (1 - share))
    return 0.0 if spread and n * share - low >= f.deviations * spread else math.inf


def _path_scores(batches: Iterator[pa.RecordBatch], f: Filter, counts: Counts) -> Iterator[pa.RecordBatch]:
    model, parts = Bayes(f, counts), re.compile(r"[a-z]+")
    for batch in batches:
        scores = [model.score(parts.findall(x.lower())) for x in column(batch, "path").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "path_score"])


def url_verdicts(pages: DataFrame, f: Filter = Filter()) -> DataFrame:
    """page_id, host, path, rule, verdict, score, host_words, held_out of every page.

    A null url, or one without ://, has an empty host and path; no rule fits
    it, and the classifier sees no token, so its prior allows it; a score that is no more than the
    least one (a tie) allows too. Long urls and long labels are read whole; words have
    `longest` letters at most. Repeated rows are judged each; an empty
    table gives no rows; other columns are not read. held_out: the host is not
    learnt from.
    """
    fold = F.crc32(F.col("host").cast("binary")) % f.folds == 0
    parts = with_parts(pages).withColumn("rule", _rule(f.rules, 0)).withColumn("ruled", _rule(f.rules, 1)).withColumn("held_out", fold)
    hosts = checkpointed(parts.groupBy("host").agg(F.max(F.coalesce(F.col("ruled") == "block", F.lit(False))).alias("bad_host")))
    labels = checkpointed(segmented(hosts, checkpointed(word_counts(pages, f)), f))
    counts = learnt_counts(parts, labels, f)
    parts = parts.mapInArrow(lambda it: _path_scores(it, f, counts), "page_id long, host string, path string, rule string, ruled string, held_out boolean, path_score double")
    scores = host_scores(hosts, labels, f, counts).withColumnRenamed("host", "of_host")
    scores = checkpointed(hosts.join(scores, F.col("host") == F.col("of_host"), "left").select(F.col("host").alias("of_host"), "bad_host", "host_score", "host_words"))
    score = F.col("path_score") + F.coalesce("host_score", F.lit(0.0))
    judged = checkpointed(parts.join(scores, parts["host"] == scores["of_host"], "left").withColumn("score", score))
    blocked = F.when(F.col("score") > least_score(judged, f), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", blocked).alias("verdict"), F.round("score", 6).alias("score"), "host_words", "held_out")
