"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distance.

Fingerprints at `radius` or fewer differing bits are linked. The 64 bits are
split into blocks; a close pair must agree on all but `radius` of them, so it
shares at least one choice of `agree` blocks. Candidates meet in those choices
only, and each bucket gives a spanning forest of its verified links, not all
pairs. Fingerprints of a bucket that is too large to compare all with all meet
at the values halfway between them instead, an exact way without large groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .session import checkpointed
from .textkit import buffers, column

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Rows compared with each other in one bucket at most.
BUCKET = 1024
#: Crowded buckets' keys that are broadcast at most (16 bytes each); more meet their rows in a salted join.
MOST_CROWDED, SALTS = 1 << 18, 32


def fingerprint_of(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the shingles' XXH64 bits; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    counts, n = np.zeros(64, np.int64), len(starts)
    stops = ends[size - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        packed = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])])
        counts += np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(column(batch, "text"))
        raw = data.tobytes()
        found = [fingerprint_of(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        signed = np.array(found, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(signed)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _bounds(bits: int, parts: int) -> list[tuple[int, int]]:
    cuts = [bits * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _mask(spans: list[tuple[int, int]]) -> int:
    m = 0
    for a, b in spans:
        m |= ((1 << (b - a)) - 1) << a
    return m - (1 << 64) if m >> 63 else m


def _scheme(n: int) -> list[int]:
    """Masks of the block choices: so many agreeing blocks that their bits tell `n` fingerprints apart."""
    for blocks in range(RADIUS + 1, RADIUS + 5):
        agree = blocks - RADIUS
        if 64 * agree // blocks >= max(1, n).bit_length() + 1:
            break
    spans = _bounds(64, blocks)
    return [_mask(list(c)) for c in combinations(spans, agree)]


def _halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): every 64-bit value at most RADIUS / 2 bits from a fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    assert RADIUS == 4
    for batch in batches:
        fps = column(batch, "fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(0, len(fps), 64):
            some = fps[k : k + 64]
            keys = (some[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(some, len(flips)).view(np.int64))], ["key", "fp"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each bucket's links, from verified distances."""
    for batch in batches:
        src, dst = [], []
        for group in column(batch, "fps"):
            fps = np.array(group.as_py(), np.int64).view(np.uint64)
            root = np.arange(len(fps))
            for i in range(1, len(fps)):
                near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= RADIUS)
                if len(near):
                    for r in np.unique(root[near]).tolist():
                        src.append(int(fps[i].view(np.int64)))
                        dst.append(int(fps[near[root[near] == r][0]].view(np.int64)))
                        root[root == r] = i
                    root[i] = i
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _of_crowded(keyed: DataFrame, crowded: DataFrame, few: bool, how: str) -> DataFrame:
    """`keyed` joined with the crowded buckets (left_semi or left_anti); no task gets all rows of one of them."""
    if few:
        return keyed.join(F.broadcast(crowded), ["mask", "key"], how)
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    every = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["mask", "key", "salt"], how).drop("salt")


def links(distinct: DataFrame, bucket: int = BUCKET, most_crowded: int = MOST_CROWDED) -> DataFrame:
    """(src, dst) fingerprints at most RADIUS bits apart; their closure is that of all such pairs."""
    keyed = distinct.select("fp", F.explode(F.array([F.lit(m) for m in _scheme(distinct.count())])).alias("mask"))
    keyed = keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))  # summed before the shuffle
    crowded = checkpointed(sizes.where(F.col("n") > bucket).select("mask", "key"))
    few = crowded.count() <= most_crowded
    # crowded buckets' rows leave before the others are dealt by bucket
    groups = _of_crowded(keyed, crowded, few, "left_anti").groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    edges = groups.select("fps").mapInArrow(_forest, "src long, dst long")
    # two fingerprints are within RADIUS if and only if some value is within half of it of both, and
    # no more than 2,081 fingerprints are that near a value: linear work, and bounded groups
    members = _of_crowded(keyed, crowded, few, "left_semi").select("fp").distinct()
    near = members.mapInArrow(_halfway, "key long, fp long").groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = near.select(F.explode("fps").alias("src"), F.array_min("fps").alias("dst")).where("src <> dst")
    return edges.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id).

    Null and blank texts have fingerprint zero and link like any other; texts
    of fewer than four words are one shingle; copies share a fingerprint and
    are never paired with each other. A null doc_id keeps its row; it takes the
    component's smallest id that is not null. Long texts are hashed whole, in
    pieces. Repeated rows are kept each; an empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    fps = checkpointed(fingerprints(docs))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("fp")))
    linked = found.join(nodes, found["node"] == nodes["fp"]).select("node", "component", "first")
    least = checkpointed(linked.groupBy("component").agg(F.min("first").alias("least")))
    named = linked.join(least, "component").select("node", "least")
    named = nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
