"""Documents in blocks, window anchors, and the round trips between blocks and parts.

Documents are packed into compressed blocks, dealt by a hash of doc_id and of
bounded size each. A round trip sends what a block knows (distinct keys with
their smallest doc_id) to parts, where equal keys of all blocks meet, and
brings back a few bits per key. A key is sent once a block, however many of
its documents hold it, so a hot key costs a part as many entries as there are
blocks, and the answers never expand into pairs.

Anchors: each window of `size` symbols picks the leftmost of the k-grams of
least hash in it. Equal windows pick equal k-grams at equal places, so a window
can only repeat where its anchor's k-gram does, and alike around it.

What a block has worked out (its anchors, its windows) travels along with a
trip as its state, so that the next trip goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .session import shuffle_width
from .textkit import U64, buffers, column, mix

#: Characters of a block, about, and of one at least where there are fewer tasks than that.
BLOCK, SMALLEST = 12_000_000, 1_000_000
#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def dump(*arrays: np.ndarray) -> bytes:
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        parts += [np.dtype(a.dtype).str.ljust(8).encode(), np.array([len(a)], "<i8").tobytes(), np.ascontiguousarray(a).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def load(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        kind = np.dtype(raw[at : at + 8].decode().strip())
        n = int(np.frombuffer(raw, "<i8", 1, at + 8)[0])
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


@dataclass
class Block:
    """Documents in order of doc_id (then text): ids, bytes, offsets; `null` marks missing ids."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    @staticmethod
    def of(blobs: Iterable[bytes]) -> Block:
        ids, texts, null = [], [], []
        for blob in blobs:
            i, size, raw, none = load(blob)
            ends = np.cumsum(size)
            raw = raw.tobytes()
            ids += i.tolist()
            null += none.tolist()
            texts += [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in order], dtype=np.int64)]).astype(np.int64)
        return Block(np.array([ids[k] for k in order], np.int64), np.frombuffer(b"".join(texts[k] for k in order), np.uint8), offsets, np.array([null[k] for k in order], bool))


def _pack(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = column(batch, "doc_id")
        null = np.asarray(own.is_null().to_numpy(zero_copy_only=False), bool)
        ids = own.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        data, off = buffers(column(batch, "text"))
        which = (mix(ids.view(U64) + U64(77)) % U64(blocks)).astype(np.int64)
        size = np.diff(off)
        keys, blobs = [], []
        for b in np.unique(which).tolist():
            rows = np.flatnonzero(which == b)
            raw = np.concatenate([data[off[r] : off[r + 1]] for r in rows.tolist()])
            keys.append(b)
            blobs.append(dump(ids[rows], size[rows], raw, null[rows]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["block", "docs"])


def packed(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(block, docs) rows, the number of blocks and of characters; a block has several rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK), min(shuffle_width(docs.sparkSession), -(-chars // SMALLEST)))
    return texts.mapInArrow(lambda it: _pack(it, blocks), "block long, docs binary"), blocks, chars


MESSAGE = "part long, block long, kind int, body binary"
REPLY = "block long, part long, kind int, body binary"
#: The kind of a block's state, which a part sends back as it is.
STATE = 0

Replies = dict[int, dict[int, list[np.ndarray]]]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 4
    kinds = {"kind": pa.int32(), "body": pa.binary()}
    return pa.table([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols)], names)


def _rows(table: pa.Table | None) -> list[tuple[int, int, bytes]]:
    if table is None:
        return []
    return sorted(zip(column(table, "part").to_pylist(), column(table, "kind").to_pylist(), column(table, "body").to_pylist()))


def _replies(table: pa.Table | None) -> Replies:
    had: Replies = {}
    for part, k, body in _rows(table):
        had.setdefault(k, {})[part] = load(body)
    return had


def state(replies: Replies) -> list[np.ndarray]:
    """The block's state of the trip before."""
    return next(iter(replies[STATE].values()))


def send(blocks: DataFrame, replies: DataFrame | None, kind: int, parts: int, ask: Callable[[Block, Replies], tuple[dict[int, bytes], bytes]]) -> DataFrame:
    """Messages of trip `kind`: ask(block, replies of the trip before) gives a body for each part, and the block's state."""

    def work(left: pa.Table, right: pa.Table | None) -> pa.Table:
        rows = []
        if left.num_rows:
            block = column(left, "block")[0].as_py()
            got, kept = ask(Block.of(x.as_py() for x in column(left, "docs")), _replies(right))
            rows = [(p, block, kind, body) for p, body in sorted(got.items())] + [(block % parts, block, STATE, kept)]
        return _table(rows, ["part", "block", "kind", "body"])

    if replies is None:
        return blocks.groupBy("block").applyInArrow(lambda t: work(t, None), MESSAGE)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(work, MESSAGE)


def answer(messages: DataFrame, judge: Callable[[list[list[np.ndarray]]], list[list[np.ndarray]]]) -> DataFrame:
    """Replies: judge(bodies of a part, one a block in order) gives a body for each."""

    def work(table: pa.Table) -> pa.Table:
        rows, ask = [], []
        part = column(table, "part")[0].as_py()
        for block, kind, body in sorted(zip(column(table, "block").to_pylist(), column(table, "kind").to_pylist(), column(table, "body").to_pylist())):
            if kind == STATE:
                rows.append((block, part, kind, body))
            else:
                ask.append((block, kind, load(body)))
        for (block, kind, _), got in zip(ask, judge([a for _, _, a in ask]) if ask else []):
            rows.append((block, part, kind, dump(*got)))
        return _table(rows, ["block", "part", "kind", "body"])

    return messages.groupBy("part").applyInArrow(work, REPLY)


def conclude(blocks: DataFrame, replies: DataFrame, schema: str, result: Callable[[Block, Replies], pa.Table]) -> DataFrame:
    empty = pa.schema([])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        return result(Block.of(x.as_py() for x in column(left, "docs")), _replies(right))

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(work, schema)


#: Low bits of a gram's hash that make way for its position. As many in a block of any size, so that
#: equal windows compare the same upper bits and the same order of places, and pick the same anchor everywhere.
PLACE_BITS = 32


@dataclass
class Runs:
    """Runs of consecutive windows first..last (starts) that pick the k-gram at `anchor`."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return Runs(cat([r.first for r in parts]), cat([r.last for r in parts]), cat([r.anchor for r in parts]))


def window_runs(grams: np.ndarray, offsets: np.ndarray, size: int, k: int) -> Runs:
    """`grams`: hash of the k-gram at each symbol; `offsets`: of the texts, in symbols."""
    n, width = len(grams), size - k + 1
    none = np.zeros(0, np.int64)
    if n < size:
        return Runs(none, none, none)
    if n >> PLACE_BITS:
        raise ValueError("a text of 2^32 symbols or more")
    place = U64((1 << PLACE_BITS) - 1)  # the position stands in the low bits: of equal upper bits the leftmost is least
    least = (grams & ~place) | np.arange(n, dtype=U64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    p = np.arange(n - size + 1)
    at = (least[: len(p)] & place).astype(np.int64)
    # windows within one text
    fits = np.zeros(n + 1, np.int64)
    longer = np.flatnonzero(np.diff(offsets) >= size)
    np.add.at(fits, offsets[longer], 1)
    np.add.at(fits, offsets[longer + 1] - size + 1, -1)
    p = np.flatnonzero(np.cumsum(fits)[: len(p)] > 0)
    at = at[p]
    if not len(p):
        return Runs(none, none, none)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)])
    ends = np.r_[new[1:], len(p)] - 1
    return Runs(p[new], p[ends], at[new])


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, `size` of them."""
    return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def coded(sorted_values: np.ndarray) -> np.ndarray:
    """Steps between ascending numbers, in the least type that holds them."""
    steps = np.diff(sorted_values, prepend=0)
    most = int(steps.max()) if len(steps) else 0
    return steps.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)


def values(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


def bits(*flags: np.ndarray) -> list[np.ndarray]:
    return [np.array([len(flags[0])], np.int64), *(np.packbits(f) for f in flags)]


def flags(body: list[np.ndarray]) -> list[np.ndarray]:
    return [np.unpackbits(x, count=int(body[0][0])).astype(bool) for x in body[1:]]


def covered(n: int, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Symbols within a window that starts in any first..last."""
    diff = np.zeros(n + 1, np.int64)
    np.add.at(diff, first, 1)
    np.add.at(diff, last + size, -1)
    return np.cumsum(diff)[:n] > 0
