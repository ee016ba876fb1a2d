"""Mixing sources to target weights: soft membership and projected gradients.

A classifier fitted to the labelled table gives each document a posterior over
domains. Nonnegative document rates are then fitted by least squares, so that
the expected tokens of each domain match the targets: projected gradient steps
from rate one on, each preconditioned with the curvature of the documents whose
rate is above zero (a matrix of domains by domains), so few steps do however
rare a domain is. Each step is one distributed sum over all documents and their
exact posteriors; its direction, a number a domain, is all that a step leaves,
and the list of directions gives every document's rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .session import checkpointed
from .textkit import NON_ALNUM, SPACE, U64, buffers, column, mix, slices, words
from .toxicity import Ftrl, dense, features, train

#: Domains by label: a toxic document, else one of low quality, else a good one.
DOMAINS = ("good", "low", "toxic")


@dataclass(frozen=True)
class Mix:
    """targets: token share of each domain; steps: at most, then the fit fails;
    tolerance: relative to each target. The classifier learns from a bounded sample
    of labelled rows: about classifier.most_rows."""

    targets: tuple[float, ...] = (0.9, 0.09, 0.01)
    steps: int = 40
    tolerance: float = 1e-4
    classifier: Ftrl = Ftrl(most_rows=6000, epochs=3)


#: Step lengths that a step tries at once.
LENGTHS = (1.0, 0.5, 0.25, 0.0625)


def shaped(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word features and the binned shape of a text: its length, its symbols, its repeated words."""
    rows, x = features(data, offsets, bits)
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))
    total = np.concatenate([[0], np.cumsum(NON_ALNUM[data] & ~SPACE[data])])
    symbols = (total[offsets[1:]] - total[offsets[:-1]]) / size
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    breaks = (lines[offsets[1:]] - lines[offsets[:-1]]) / size
    first = len(words(data, offsets, NON_ALNUM)[0])  # the words themselves come first
    count = np.bincount(rows[:first], minlength=n)
    unlike = np.bincount(np.unique((rows[:first] << bits) | x[:first]) >> bits, minlength=n) / np.maximum(1, count)
    bins = [np.log2(1 + size).astype(int), np.minimum(31, symbols * 64).astype(int), np.minimum(31, breaks * 256).astype(int), (unlike * 16).astype(int)]
    shape = [(mix((np.full(n, 1 + k, U64) << U64(32)) + b.astype(U64)) >> U64(64 - bits)).astype(np.int64) for k, b in enumerate(bins)]
    return np.concatenate([rows, *[np.arange(n)] * len(bins)]), np.concatenate([x, *shape])


def posteriors(docs: DataFrame, labels: DataFrame, p: Mix, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, q): q has each domain's posterior. doc_id is the column `key`."""
    domain = F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0.0)
    known = labels.select("doc_id", domain.alias("domain"))
    models = train(docs, known, "domain", p.classifier, [float(k) for k in range(len(DOMAINS))], shaped)
    bits = p.classifier.bits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [dense(m, bits).astype(np.float32) for m in models]
        used = np.any(weights, axis=0)
        for batch in batches:
            data, off = buffers(column(batch, "text"))
            each = np.empty((len(off) - 1, len(models)))
            tokens = np.zeros(len(off) - 1, np.int64)
            for i, j in slices(off):
                part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
                rows, x = shaped(part, own, bits)
                hit = np.flatnonzero(used[x])
                key = np.unique((rows[hit] << bits) | x[hit])
                own_rows, own_x = key >> bits, key & ((1 << bits) - 1)
                for k, m in enumerate(models):
                    each[i:j, k] = m[0] + np.bincount(own_rows, weights[k][own_x], minlength=j - i)
                tokens[i:j] = np.bincount(words(part, own, SPACE)[2], minlength=j - i)
            chance = 1 / (1 + np.exp(-np.clip(each, -30, 30)))
            chance /= chance.sum(axis=1, keepdims=True)
            q = pa.FixedSizeListArray.from_arrays(pa.array(chance.ravel()), len(models)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(tokens), q], ["doc_id", "n_tokens", "q"])

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score, "doc_id long, n_tokens long, q array<double>")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def rates(q: np.ndarray, directions: list[list[float]]) -> np.ndarray:
    rate = np.ones(len(q))
    for d in directions:
        rate = np.maximum(0.0, rate - q @ np.array(d))
    return rate


def fit_rates(scored: DataFrame, p: Mix) -> list[list[float]]:
    """The directions of the steps; `scored` has (n_tokens, q)."""
    targets = np.array(p.targets) / sum(p.targets)
    n = len(targets)
    total = scored.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return []

    def sums(options: list[list[list[float]]], y: np.ndarray) -> tuple[np.ndarray, float]:
        """Of each list of directions: the domains' tokens, then the curvature of the documents with a rate above zero. Then the least q y of all documents with tokens."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, least = np.zeros((len(options), n + n * n)), np.inf
            for batch in batches:
                q, tokens = matrix(batch), column(batch, "n_tokens").to_numpy().astype(float)
                for k, d in enumerate(options):
                    rate = rates(q, d)
                    out[k, :n] += (rate * tokens) @ q
                    out[k, n:] += ((q * (tokens * (rate > 0))[:, None]).T @ q).ravel()
                least = min(least, (q @ y)[tokens > 0].min(initial=np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size + 1)), pa.array([*out.ravel(), least])], ["k", "v"])

        got = scored.mapInArrow(work, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"), F.min("v").alias("least")).collect()
        out, least = np.zeros(len(options) * (n + n * n)), np.inf
        for r in got:
            if r["k"] < len(out):
                out[r["k"]] = r["v"] / total
            else:
                least = r["least"]
        return np.round(out.reshape(len(options), -1), 12), least

    directions: list[list[float]] = []
    now = sums([directions], np.zeros(n))[0][0]
    beyond = False
    for _ in range(p.steps):
        off = now[:n] - targets
        if np.all(np.abs(off) <= p.tolerance * targets):
            return directions
        curve = now[n:].reshape(n, n)
        step = np.linalg.lstsq(curve, off, rcond=1e-9)[0]
        plain = off / targets**2  # without the preconditioner, as far as a line goes best
        ahead = curve @ plain / targets
        plain = plain * ((off / targets) @ ahead / max(ahead @ ahead, 1e-300))
        options = [[*directions, (x * d).round(12).tolist()] for x in LENGTHS for d in (step, plain)]
        y = off / targets**2
        got, least = sums(options, y)
        # shares are weighted means of posteriors: if all of these are on one side of a plane, and the targets on the other, no rates reach them
        beyond = beyond or least > targets @ y + 1e-9 * np.abs(y).max()
        error = (((got[:, :n] - targets) / targets) ** 2).sum(axis=1)
        best = int(error.argmin())
        if error[best] >= ((off / targets) ** 2).sum() * (1 - (p.tolerance if beyond else 1e-9)):
            return directions  # no nearer to the targets: a domain is out of reach
        directions, now = options[best], got[best]
    if beyond:
        return directions
    raise RuntimeError(f"rates did not settle in {p.steps} steps: {now[:n].tolist()} for {targets.tolist()}")


def reached(rated: DataFrame) -> DataFrame:
    """(domain, share): expected share of tokens that the rates give each domain, of all tokens at rate one."""
    total = F.sum("n_tokens")
    return rated.agg(*[(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) / total).alias(d) for d in DOMAINS]).select(F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).alias("share")) for d in DOMAINS])).alias("e")).select("e.*")


def mix_rates(docs: DataFrame, labels: DataFrame, p: Mix = Mix(), key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, p_good, p_low, p_toxic, rate of every document.

    A null or empty text has no tokens and gets its posterior's rate all the
    same; equal posteriors (ties) get equal rates; long texts count whole. The
    targets are met within the tolerance, or the fit fails; where they are out
    of reach (no nonnegative rates of these posteriors give them, which a plane
    between the two proves), the nearest shares that the steps find are kept.
    Without labels every posterior is even and the rates are equal. Repeated
    rows count each; an empty table gives no rows; other columns are not read,
    but for `key`, which then stands as doc_id in the result (labels go by doc_id).
    """
    scored = checkpointed(posteriors(docs, labels, p, key))  # narrow: a count and three numbers a document
    directions = fit_rates(scored, p)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_tokens"), *(pa.array(q[:, k]) for k in range(len(DOMAINS))), pa.array(np.round(rates(q, directions), 9))], ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate"])

    return scored.mapInArrow(rated, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double")
