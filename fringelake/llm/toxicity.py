"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, neighbouring pairs and pairs with one word between are hashed into
2**bits coordinates. Each coordinate has its own learning rate, and the L1 term
leaves few weights, so what goes to the executors is a short list of
coordinates with a bound known beforehand.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import FOLDED, NON_ALNUM, U64, Bytes, buffers, column, mix, slices, words


@dataclass(frozen=True)
class Ftrl:
    """most_rows: about so many labelled rows are learnt from, chosen by a hash of doc_id; the fit's only bound on rows."""

    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 4
    most_rows: int = 12000


PAIR = (U64(0x9E6C63D0876A9A35), U64(0xC2B2AE3D27D4EB4F))
SKIP = (U64(0x165667B19E3779F9), U64(0xD1B54A32D192ED03))


#: Bytes of a word's beginning that count as a word of their own; they catch inflected forms.
STEMS = (4, 5, 6, 7, 8)
STEM = U64(0xE7037ED1A0B428DB)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, stem, pair and skip pair; pairs stay within a text."""
    starts, ends, rows = words(data, offsets, NON_ALNUM)
    text = Bytes(data, FOLDED)
    h = text.hash(starts, ends)
    shift = U64(64 - bits)
    found_rows, found = [rows], [mix(h) >> shift]
    for n in STEMS:
        longer = np.flatnonzero(ends - starts > n)
        found_rows.append(rows[longer])
        found.append(mix(text.hash(starts[longer], starts[longer] + n) ^ STEM) >> shift)
    for gap, (a, b) in ((1, PAIR), (2, SKIP)):
        if len(h) > gap:
            same = rows[gap:] == rows[:-gap]
            found_rows.append(rows[gap:][same])
            found.append(mix(h[:-gap] * a + h[gap:] * b)[same] >> shift)
    return np.concatenate(found_rows), np.concatenate(found).astype(np.int64)


Features = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def vectors(batches: Iterator[pa.RecordBatch], bits: int, use: Features = features) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, x): x has a text's distinct coordinates as int32 bytes."""
    for batch in batches:
        data, off = buffers(column(batch, "text"))
        out = []
        for i, j in slices(off):
            rows, x = use(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
            key = np.unique((rows << bits) | x)
            cuts = np.searchsorted(key, np.arange(j - i + 1, dtype=np.int64) << bits)
            ids = (key & ((1 << bits) - 1)).astype(np.int32)
            out += [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "label"), pa.array(out, pa.binary())], ["doc_id", "label", "x"])


def fit(samples: list[tuple[np.ndarray, float]], p: Ftrl) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, coordinates, weights) after FTRL-proximal passes in a fixed order."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bz, bn = 0.0, 0.0
    bias = 0.0
    for epoch in range(p.epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(samples)):
            x, y = samples[k]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= p.l1, 0.0, (np.sign(zx) * p.l1 - zx) / ((p.beta + root) / p.alpha + p.l2))
            bias = -bz / ((p.beta + bn**0.5) / p.alpha)
            g = 1 / (1 + np.exp(-min(35.0, max(-35.0, bias + w.sum())))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / p.alpha * w
            n[x] = nx + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / p.alpha * bias
            bn += g * g
    w = np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    kept = np.flatnonzero(w)
    return float(bias), kept, w[kept]


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def training(docs: DataFrame, labels: DataFrame, label: str, p: Ftrl) -> DataFrame:
    """(doc_id, label, text) of the rows to learn from: labelled, not held out, at most about p.most_rows.

    A document labelled more than once counts once, with its largest label.
    """
    ids = F.col("doc_id").cast("long")
    known = labels.select(ids.alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, p.most_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return docs.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")


def _learnt(batches: Iterator[pa.RecordBatch], p: Ftrl, classes: list[float] | None = None) -> Iterator[pa.RecordBatch]:
    rows = [(d.as_py(), y.as_py(), np.frombuffer(x.as_py(), np.int32)) for b in batches for d, y, x in zip(*b.columns)]
    rows.sort(key=lambda r: (r[0], len(r[2])))
    for k, c in enumerate(classes or [1.0]):
        bias, at, w = fit([(x, float(y == c)) for _, y, x in rows], p) if rows else (0.0, np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bias]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w.astype("<f8").tobytes()], pa.binary())], ["k", "bias", "at", "w"])


def train(docs: DataFrame, labels: DataFrame, label: str, p: Ftrl, classes: list[float] | None = None, use: Features = features) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """One model a class; the samples meet in one task, a bounded number of them."""
    bits = p.bits
    x = training(docs, labels, label, p).mapInArrow(lambda it: vectors(it, bits, use), "doc_id long, label double, x binary")
    rows = x.repartition(1).mapInArrow(lambda it: _learnt(it, p, classes), "k long, bias double, at binary, w binary").collect()
    return [(r["bias"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["w"], "<f8")) for r in sorted(rows, key=lambda r: r["k"])]


def dense(model: tuple[float, np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    w = np.zeros(1 << bits)
    w[model[1]] = model[2]
    return w


def margins(rows: np.ndarray, x: np.ndarray, weights: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Sum of the weights of each of n texts' distinct coordinates."""
    hit = np.flatnonzero(weights[x])
    key = np.unique((rows[hit] << bits) | x[hit])
    return np.bincount(key >> bits, weights[key & ((1 << bits) - 1)], minlength=n)


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Only the text enters a score. Null and empty texts get the bias's score; a
    null doc_id keeps its row, with held_out false. Without any labels to learn
    from all scores are 0.5. Repeated rows are scored each; long texts are
    scored whole; a score of 0.5 (a tie) is predicted 1. An empty table gives
    no rows; columns other than those named are not read.
    """
    model = train(docs, labels, "toxic", p)[0]
    bits = p.bits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dense(model, bits)
        for batch in batches:
            data, off = buffers(column(batch, "text"))
            s = np.full(len(off) - 1, model[0])
            for i, j in slices(off):
                s[i:j] += margins(*features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits), weights, bits, j - i)
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            ids = column(batch, "doc_id")
            out = [ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
