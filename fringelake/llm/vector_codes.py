"""Vector code compression: product quantisation trained by tree aggregation.

Vectors become blocks of NumPy parts, one column a dimension. A round is one
`treeAggregate` over an RDD of blocks: a task adds up squared distances dimension
by dimension, takes the nearest codebook entry of each part, and adds
its parts to int64 tensors of sums and counts with `np.add.at`; the tensors (parts x
entries x width numbers, whatever the number of vectors) merge through the
reduction tree, and only the last few reach the driver. A lost task reads its
blocks from the shared checkpoint folder again.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .session import checkpointed
from .textkit import column
from .vectors import Block, arithmetic, blocks, cleaned, loaded, long, nullable, usual_size, whole


@dataclass(frozen=True)
class Codes:
    """parts: of a vector; entries: of a part's codebook (256 at most); rounds: of training; scale:
    steps a unit, a power of two; depth: of the reduction tree; dims: components, or None for
    the usual number of the table."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    depth: int = 2
    dims: int | None = None


Tensors = tuple[np.ndarray, np.ndarray]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each of the columns of `x` (width x n) in `book` (entries x width); ties to the lower entry."""
    kind = arithmetic(len(x), x, book)
    gap = np.zeros((x.shape[1], len(book)), kind)
    for d in range(len(x)):
        step = x[d].astype(kind)[:, None] - book[:, d].astype(kind)[None, :]
        gap += step * step
    entry = gap.argmin(axis=1)
    return entry, gap[np.arange(len(entry)), entry].astype(object if kind is object else np.int64)


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by part and vector, error by vector) of the columns of `x`."""
    parts, _, width = books.shape
    found = [nearest(x[p * width : (p + 1) * width], books[p]) for p in range(parts)]
    return np.array([f[0] for f in found]), np.sum([f[1] for f in found], axis=0)


def gathered(had: Tensors | None, block: Block, books: np.ndarray) -> Tensors:
    """`had`, and the block's sums and counts by part and entry."""
    parts, _, width = books.shape
    x = np.ascontiguousarray(block.x.T)
    kind = np.int64 if x.dtype != object else object
    total, count = np.zeros(books.shape, kind), np.zeros(books.shape[:2], np.int64)
    entry, _ = coded(x, books)
    for p in range(parts):
        np.add.at(count[p], entry[p], 1)
        np.add.at(total[p], entry[p], x[p * width : (p + 1) * width].T.astype(kind))
    return merged(had, (total, count))


def merged(a: Tensors | None, b: Tensors | None) -> Tensors | None:
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def replaced(books: np.ndarray, tensors: Tensors | None) -> np.ndarray:
    """Each used entry becomes the floor of its parts' mean."""
    if tensors is None:
        return books
    total, count = tensors
    means = total // np.maximum(count, 1)[:, :, None]
    return np.where(count[:, :, None] > 0, means, books)


def books_of(packed: DataFrame, clean: DataFrame, dims: int, c: Codes) -> np.ndarray:
    """The trained codebooks (parts x entries x width)."""
    first = clean.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(c.entries).collect()
    seeds = whole(np.array([r["embedding"] for r in first], np.float64).reshape(-1, dims), c.scale)
    width = dims // c.parts
    books = seeds.reshape(len(seeds), c.parts, width).transpose(1, 0, 2)
    books = books.astype(np.int64) if books.dtype != object else books
    if not len(seeds):
        return books
    rdd = loaded(packed)
    for _ in range(c.rounds):
        now = books
        books = replaced(now, rdd.treeAggregate(None, lambda had, block: gathered(had, block, now), merged, depth=c.depth))
    return books


def _rows(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Codes of the blocks' vectors; equal digits are written at once for all vectors."""
    digits = np.frombuffer(b"".join(b"%02x" % k for k in range(256)), np.uint8).reshape(256, 2)
    for batch in batches:
        for body in column(batch, "body").to_pylist():
            block = pickle.loads(body)
            entry, error = coded(np.ascontiguousarray(block.x.T), books)
            text = np.ascontiguousarray(digits[entry.T]).reshape(len(block.ids), -1)
            codes = pa.array([bytes(t).decode() for t in text], pa.string())
            yield pa.RecordBatch.from_arrays(
                [nullable(block.ids, block.no_id), nullable(block.labels, block.no_label), codes, pa.array([long(e) for e in error.tolist()], pa.int64())], ["vec_id", "label", "code", "error"]
            )


def compressed(vectors: DataFrame, c: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of `vectors` (vec_id, embedding, label).

    Null vectors, vectors with null or non-finite components and those of
    another length than most (a code needs equal parts) have no row. A null vec_id
    comes after all others; of rows that share an id those with the smaller
    components come first. Repeated rows count each. Fewer vectors than entries make
    smaller codebooks; an empty table gives no rows. Components of any
    magnitude are exact; an error that a long can't hold is null, and a label's error is
    null where its sum can't be held. A null label is a label. Columns other than those
    named are not read.
    """
    if c.entries > 256:
        raise ValueError("two digits hold 256 entries at most")
    dims = c.dims or usual_size(vectors, c.parts)
    if dims % c.parts:
        raise ValueError(f"{dims} components can't be cut into {c.parts} equal parts")
    clean = cleaned(vectors, dims)
    packed = blocks(clean, dims, c.scale)
    books = books_of(packed, clean, dims, c)
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    rows = checkpointed(packed.mapInArrow(lambda it: _rows(it, books), "vec_id long, label long, code string, error long"))
    whole_sum = F.when(F.count(F.lit(1)) == F.count("error"), F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)"))
    by_label = rows.groupBy("label").agg(whole_sum.alias("label_error")).select(F.col("label").alias("of"), "label_error")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(c: Codes = Codes(dims=64)) -> str:
    """The same for DuckDB, round by round."""
    width = c.dims // c.parts
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({c.scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        f"dims AS (SELECT d, d // {width} AS part, d % {width} AS pos FROM (SELECT unnest(range({c.dims})) AS d))",
        "x AS MATERIALIZED (SELECT vec_id, part, pos, e[d + 1] AS x FROM v, dims)",
        f"c0 AS MATERIALIZED (SELECT part, k, pos, e[d + 1] AS x FROM (SELECT e, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY k LIMIT {c.entries}), dims)",
    ]
    for r in range(c.rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(k, (g, k)) AS k, min(g) AS g FROM (SELECT vec_id, part, k, sum((x.x - c.x) * (x.x - c.x)) AS g FROM x JOIN c{r} AS c USING (part, pos) GROUP BY ALL) GROUP BY vec_id, part)")
        if r < c.rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, k, pos, coalesce(n.x, c.x)::BIGINT AS x FROM c{r} AS c LEFT JOIN (SELECT part, k, pos, {mean} AS x FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) AS n USING (part, k, pos))")
    last = c.rounds
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(g)::BIGINT AS error FROM a{last} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, k, pos)) FROM c{last}) AS codebooks_sha256
        FROM coded JOIN v USING (vec_id)"""


#: Of the default codes on vectors of 64 components.
SQL = sql()
