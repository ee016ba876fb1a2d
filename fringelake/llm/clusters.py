"""Centroid clustering by Exponion search, on whole numbers.

Vectors stay in blocks, and each block has a state: its vectors' centroids, an upper
bound of the distance to them, and a lower bound of the distance to any other.
A round moves the bounds by how far the centroids went. A vector whose bounds
still tell its centroid from all others is left; any other scans
only the centroids in a ball around its present one, taken from that centroid's
list of the others by distance. The ball's radius is twice the vector's distance plus
the distance to the next centroid, itself included, so a tie is never missed.
Squared distances are whole numbers and decide; bounds are doubles, rounded
outwards at every step.

States are small beside vectors and are persisted from round to round; vectors
are read from the shared checkpoint folder and never written again. Sums meet in
a reduction tree.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from .textkit import column
from .vectors import Block, arithmetic, blocks, cleaned, loaded, long, nullable, whole


@dataclass(frozen=True)
class Clustering:
    """clusters: at most `MOST`; rounds: of assigning and moving; dims: components; scale: steps a unit, a
    power of two; salt: put before a vec_id to draw the first centroids; depth: of the
    reduction tree; every: rounds after which the states' lineage is cut."""

    clusters: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    salt: str = "3:"
    depth: int = 2
    every: int = 4


#: The lists of centroids by distance have a number for each pair of centroids.
MOST = 4096
#: Differences worked out at once.
PIECE = 1 << 20


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def squares(x: np.ndarray, c: np.ndarray, kind: type) -> np.ndarray:
    """Squared distance of each row of `x` to `c` (a row, or one for each), as whole numbers."""
    out = np.empty(len(x), object if kind is object else np.int64)
    rows = max(1, PIECE // max(1, x.shape[1]))
    for at in range(0, len(x), rows):
        own = c if c.ndim == 1 else c[at : at + rows]
        step = x[at : at + rows].astype(kind) - own.astype(kind)
        out[at : at + rows] = (step * step).sum(axis=1) if kind is object else np.einsum("ij,ij->i", step, step)
    return out


def longest(square: np.ndarray) -> np.ndarray:
    """A double not below the root of whole numbers."""
    return _up(np.sqrt(_up(square.astype(np.float64))))


def shortest(square: np.ndarray) -> np.ndarray:
    """A double not above the root of whole numbers."""
    return _down(np.sqrt(_down(square.astype(np.float64))))


@dataclass
class Model:
    """Centroids; for each one the others by distance (itself first), bounds of these distances, and half the distance to the next."""

    at: np.ndarray
    order: np.ndarray
    near: np.ndarray
    next_far: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(at: np.ndarray) -> Model:
        k = len(at)
        kind = arithmetic(at.shape[1], at)
        square = np.array([squares(at, c, kind) for c in at]).reshape(k, k)
        low, high = shortest(square), longest(square)
        rows = np.arange(k)[:, None]
        first = square.copy()
        first[np.arange(k), np.arange(k)] = -1
        order = np.argsort(first, axis=1, kind="stable")
        alone = np.full(k, np.inf)
        return Model(at, order, low[rows, order], high[rows, order][:, 1] if k > 1 else alone, _down(low[rows, order][:, 1] / 2) if k > 1 else alone)

    def moved(self, at: np.ndarray) -> np.ndarray:
        """How far each centroid goes to `at`, at least that."""
        return np.where((self.at == at).all(axis=1), 0.0, longest(squares(self.at, at, arithmetic(at.shape[1], self.at, at))))


@dataclass
class State:
    """Of a block's vectors: the centroid, a bound above the distance to it, a bound below the distance to any other; how many distances were worked out."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: int = 0


def _scan(x: np.ndarray, rows: np.ndarray, m: Model, which: np.ndarray, many: np.ndarray, state: State, kind: type) -> None:
    """Nearest and second nearest of `rows` among the first `many` of the centroids `which`; rows have most first."""
    best, second = np.full(len(rows), -1, object if kind is object else np.int64), np.full(len(rows), np.inf)
    found = np.zeros(len(rows), np.int64)
    for r, j in enumerate(which.tolist()):
        n = int(np.searchsorted(-many, -r, side="left"))  # rows whose ball holds more than r centroids
        if not n:
            break
        square = squares(x[rows[:n]], m.at[j], kind)
        state.scanned += n
        had = best[:n]
        wins = (had < 0) | (square < had) | ((square == had) & (j < found[:n]))
        loses = np.where(wins, had, square)
        known = loses >= 0
        other = np.where(known, shortest(np.where(known, loses, 0)), np.inf)
        second[:n] = np.minimum(second[:n], other)
        best[:n] = np.where(wins, square, had)
        found[:n] = np.where(wins, j, found[:n])
    state.cluster[rows] = found
    state.upper[rows] = longest(best)
    state.lower[rows] = second


def first_state(x: np.ndarray, m: Model) -> State:
    """Every vector against every centroid."""
    n = len(x)
    state = State(np.zeros(n, np.int32), np.zeros(n), np.zeros(n))
    _scan(x, np.arange(n), m, np.arange(len(m.at)), np.full(n, len(m.at)), state, arithmetic(x.shape[1], x, m.at))
    return state


def next_state(x: np.ndarray, had: State, moved: np.ndarray, m: Model) -> State:
    """The state under `m`, to which the centroids went by `moved`."""
    kind = arithmetic(x.shape[1], x, m.at)
    k = len(m.at)
    far = np.argmax(moved)
    others = np.full(k, moved[far])
    others[far] = np.delete(moved, far).max() if k > 1 else 0.0
    a = had.cluster
    state = State(a.copy(), _up(had.upper + moved[a]), _down(had.lower - others[a]), 0)
    open_ = np.flatnonzero((state.upper >= state.lower) & (state.upper >= m.half[a]))
    if not len(open_):
        return state
    state.upper[open_] = longest(squares(x[open_], m.at[a[open_]], kind))
    state.scanned += len(open_)
    open_ = open_[(state.upper[open_] >= state.lower[open_]) & (state.upper[open_] >= m.half[a[open_]])]
    for c in np.unique(a[open_]).tolist():
        rows = open_[a[open_] == c]
        radius = _up(_up(2 * state.upper[rows]) + m.next_far[c])
        many = np.searchsorted(m.near[c], radius, side="right")
        order = np.argsort(-many, kind="stable")
        _scan(x, rows[order], m, m.order[c], many[order], state, kind)
    return state


Sums = tuple[np.ndarray, np.ndarray]


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> Sums:
    """Sums and counts of the vectors of each centroid."""
    kind = np.int64 if x.dtype != object else object
    total, count = np.zeros((k, x.shape[1]), kind), np.bincount(cluster, minlength=k).astype(np.int64)
    order = np.argsort(cluster, kind="stable")
    used = np.flatnonzero(count)
    if len(used):
        starts = np.concatenate([[0], np.cumsum(count[used])[:-1]])
        total[used] = np.add.reduceat(x[order].astype(kind), starts, axis=0)
    return total, count


def _add(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def _tree(rdd: RDD, depth: int) -> Sums | None:
    return rdd.treeAggregate(None, _add, _add, depth=depth)


def fitted(vectors: RDD, at: np.ndarray, c: Clustering) -> tuple[RDD, Model]:
    """(states under the last centroids, these) after `rounds` rounds; the states are persisted, a pair of state and sums a block."""
    m = Model.of(at)
    first, older = m, None
    states = vectors.map(lambda b: (s := first_state(b.x, first), sums(b.x, s.cluster, len(first.at))))
    for k in range(c.rounds):
        states = states.persist(StorageLevel.MEMORY_AND_DISK)
        if k % c.every == c.every - 1:
            states.checkpoint()
        total, count = _tree(states.map(lambda pair: pair[1]), c.depth)
        means = total // np.maximum(count, 1)[:, None]
        new = Model.of(np.where(count[:, None] > 0, means, m.at))
        gone = m.moved(new.at)

        def step(pair: tuple[Block, tuple[State, Sums]], new: Model = new, gone: np.ndarray = gone) -> tuple[State, Sums]:
            block, (had, _) = pair
            state = next_state(block.x, had, gone, new)
            return state, sums(block.x, state.cluster, len(new.at))

        if older is not None:
            older.unpersist()
        older, states, m = states, vectors.zip(states).map(step), new
    return states.persist(StorageLevel.MEMORY_AND_DISK), m


Ends = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _end(pair: tuple[Block, tuple[State, Sums]], m: Model) -> Ends:
    """ids, their null marks, centroids and squared distances of a block."""
    block, (state, _) = pair
    square = squares(block.x, m.at[state.cluster], arithmetic(block.x.shape[1], block.x, m.at))
    return block.ids, block.no_id, state.cluster, square


def _inertia(ends: Ends, k: int) -> Sums:
    total = np.zeros(k, object)
    np.add.at(total, ends[2], ends[3].astype(object))
    return total, np.bincount(ends[2], minlength=k)


def _rows(batches: Iterator[pa.RecordBatch], inertia: list[int | None], everything: int | None, digests: list[str]) -> Iterator[pa.RecordBatch]:
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for batch in batches:
        for body in column(batch, "body").to_pylist():
            ids, no_id, cluster, square = pickle.loads(body)
            own = cluster.tolist()
            cols = [nullable(ids, no_id), pa.array(own, pa.int32()), pa.array([long(s) for s in square.tolist()], pa.int64()), pa.array([inertia[j] for j in own], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([everything] * len(own), pa.int64()), pa.array([digests[j] for j in own], pa.string())], names)


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(vectors: DataFrame, c: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of `vectors` (vec_id, embedding).

    Null vectors, those of another length than `dims` and those with null or
    non-finite components have no row. A null vec_id comes after all others where the
    first centroids are drawn; of rows that share an id those with the smaller
    components come first; repeated rows count each. Equal centroids and other ties go to
    the smaller number. Fewer vectors than clusters make as many clusters as there
    are vectors; an empty table gives no rows. Components of any magnitude are
    exact; sums that a long can't hold are null. Columns other than those named
    are not read.
    """
    if c.clusters > MOST:
        raise ValueError(f"{MOST} clusters at most")
    spark = vectors.sparkSession
    clean = cleaned(vectors, c.dims)
    packed = blocks(clean, c.dims, c.scale)
    drawn = F.sha2(F.concat(F.lit(c.salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = clean.withColumn("drawn", drawn).orderBy(F.col("drawn").asc_nulls_last(), "embedding").limit(c.clusters).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA)
    at = whole(np.array([r["embedding"] for r in first], np.float64), c.scale)
    at = at.astype(np.int64) if at.dtype != object else at
    rdd = loaded(packed)
    states, m = fitted(rdd, at, c)
    ends = rdd.zip(states).map(lambda pair: _end(pair, m))
    total, _ = _tree(ends.map(lambda e: _inertia(e, len(at))), c.depth)
    digests = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in m.at]
    inertia, everything = [long(int(t)) for t in total], long(sum(int(t) for t in total))
    bodies = spark.createDataFrame(ends.map(lambda e: (bytearray(pickle.dumps(e, 5)),)), "body binary")
    return bodies.mapInArrow(lambda it: _rows(it, inertia, everything, digests), SCHEMA)


def sql(c: Clustering = Clustering()) -> str:
    """The same for DuckDB, round by round."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({c.scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = {c.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.dims})",
        f"x AS MATERIALIZED (SELECT vec_id, d, e[d] AS x FROM v, (SELECT unnest(range(1, {c.dims + 1})) AS d))",
        f"c0 AS MATERIALIZED (SELECT k, d, e[d] AS x FROM (SELECT e, row_number() OVER (ORDER BY sha256('{c.salt}' || vec_id)) - 1 AS k FROM v ORDER BY k LIMIT {c.clusters}), (SELECT unnest(range(1, {c.dims + 1})) AS d))",
    ]
    for r in range(c.rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, (g, k)) AS k, min(g) AS g FROM (SELECT vec_id, k, sum((x.x - c.x) * (x.x - c.x)) AS g FROM x JOIN c{r} AS c USING (d) GROUP BY ALL) GROUP BY vec_id)")
        if r < c.rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, d, coalesce(n.x, c.x)::BIGINT AS x FROM c{r} AS c LEFT JOIN (SELECT k, d, {mean} AS x FROM x JOIN a{r} USING (vec_id) GROUP BY k, d) AS n USING (k, d))")
    last = c.rounds
    return f"""WITH {", ".join(steps)},
        h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS digest FROM c{last} GROUP BY k)
        SELECT vec_id, k::INTEGER AS cluster, g::BIGINT AS distance, (sum(g) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(g) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
        FROM a{last} JOIN h USING (k)"""


#: Of the default clustering.
SQL = sql()
