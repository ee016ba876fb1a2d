"""Windows of a large object through packed tiles: gather, overlap-add and set.

An object is a table of square tiles, (ty, tx, data), the numbers of all slices in
one array. Windows stay packed. Sums are made in the tasks that hold the windows, tile by
tile, and only tiles meet in an exchange; a gather sends a tile to the windows that
start in or beside it, a bounded number in a group. No exchange has a row per
pixel of a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODES = ("constant", "nearest", "wrap", "reflect")
#: Numbers that a task holds in tiles before it passes them on, and windows of a group.
HELD, GROUP = 1 << 24, 4096


@dataclass(frozen=True)
class Tiling:
    """ny, nx: the object's pixels; nz: slices; size: of a tile."""

    ny: int
    nx: int
    nz: int = 1
    size: int = 64

    def __post_init__(self) -> None:
        if min(self.ny, self.nx, self.nz, self.size) < 1:
            raise ValueError(f"{self}: sizes are one at least")


TILE = "ty long, tx long, data array<double>"


def _col(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return _col(batch, name).to_numpy(zero_copy_only=False)


def _arrays(batch: pa.RecordBatch | pa.Table, name: str, *shape: int) -> np.ndarray:
    got = _col(batch, name)
    got = pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got
    return got.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(got), *shape)


def _lists(rows: list[np.ndarray], kind: pa.DataType = pa.float64()) -> pa.Array:
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0)
    ends = np.cumsum([0, *[r.size for r in rows]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def tiles_of(px: DataFrame, t: Tiling, value: str = "v", fill: float = 0.0) -> DataFrame:
    """(ty, tx, data) from pixels ([z,] y, x, value); what has no pixel is `fill`. Pixels outside the object are left out."""
    z = F.col("z") if "z" in px.columns else F.lit(0)
    inside = px.where(F.col("y").between(0, t.ny - 1) & F.col("x").between(0, t.nx - 1) & z.between(0, t.nz - 1))
    at = (z * t.size + F.pmod("y", F.lit(t.size))) * t.size + F.pmod("x", F.lit(t.size))
    rows = inside.select(F.floor(F.col("y") / t.size).cast("long").alias("ty"), F.floor(F.col("x") / t.size).cast("long").alias("tx"), F.struct(at.cast("long").alias("k"), F.col(value).cast("double").alias("v")).alias("p"))
    held = rows.groupBy("ty", "tx").agg(F.collect_list("p").alias("ps"))  # a tile's pixels

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = _col(batch, "ps")
            flat, ends = ps.flatten(), ps.offsets.to_numpy() - ps.offsets[0].as_py()
            k, v = flat.field("k").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False)
            out = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                tile = np.full(t.nz * t.size * t.size, fill)
                tile[k[a:b]] = v[a:b]
                out.append(tile)
            yield pa.RecordBatch.from_arrays([_col(batch, "ty"), _col(batch, "tx"), _lists(out)], ["ty", "tx", "data"])

    return held.mapInArrow(pack, TILE)


def pixels_of(tiles: DataFrame, t: Tiling) -> DataFrame:
    """(z, y, x, v) of the object's pixels in the tiles."""
    k, s = F.col("k"), t.size
    px = tiles.select("ty", "tx", F.posexplode("data").alias("k", "v"))
    px = px.select(F.floor(k / (s * s)).cast("long").alias("z"), (F.col("ty") * s + F.pmod(F.floor(k / s), F.lit(s))).cast("long").alias("y"), (F.col("tx") * s + F.pmod(k, F.lit(s))).cast("long").alias("x"), "v")
    return px.where((F.col("y") < t.ny) & (F.col("x") < t.nx))


def sum_px(sums: DataFrame, t: Tiling) -> DataFrame:
    """(z, y, x, v, n) of the pixels that a window covers."""
    k, s = F.col("k"), t.size
    counts = F.concat(*[F.col("n")] * t.nz)
    px = sums.select("ty", "tx", F.posexplode(F.arrays_zip("data", counts.alias("m"))).alias("k", "p")).where("p.m > 0")
    return px.select(F.floor(k / (s * s)).cast("long").alias("z"), (F.col("ty") * s + F.pmod(F.floor(k / s), F.lit(s))).cast("long").alias("y"), (F.col("tx") * s + F.pmod(k, F.lit(s))).cast("long").alias("x"), F.col("p.data").alias("v"), F.col("p.m").alias("n"))


def _pieces(y: int, x: int, ny: int, nx: int, t: Tiling) -> Iterator[tuple[int, int, slice, slice, slice, slice]]:
    """(ty, tx, rows and columns of the tile, rows and columns of the window) of the tiles that a window at (y, x) touches within the object."""
    for ty in range(max(y, 0) // t.size, (min(y + ny, t.ny) - 1) // t.size + 1):
        a, b = max(y, 0, ty * t.size), min(y + ny, t.ny, (ty + 1) * t.size)
        for tx in range(max(x, 0) // t.size, (min(x + nx, t.nx) - 1) // t.size + 1):
            c, d = max(x, 0, tx * t.size), min(x + nx, t.nx, (tx + 1) * t.size)
            if a < b and c < d:
                yield ty, tx, slice(a - ty * t.size, b - ty * t.size), slice(c - tx * t.size, d - tx * t.size), slice(a - y, b - y), slice(c - x, d - x)


SUMS = "ty long, tx long, data array<double>, n array<long>"


def scatter_add(windows: DataFrame, ny: int, nx: int, t: Tiling) -> DataFrame:
    """(ty, tx, data, n): sums and numbers of `windows` (start_y, start_x, data of nz * ny * nx) at each pixel of the tiles that one touches."""

    def emit(held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _lists([held[k][0] for k in keys]), _lists([held[k][1] for k in keys], pa.int64())], ["ty", "tx", "data", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            data = _arrays(batch, "data", t.nz, ny, nx)
            for y, x, own in zip(_numbers(batch, "start_y").tolist(), _numbers(batch, "start_x").tolist(), data):
                for ty, tx, rows, cols, wr, wc in _pieces(y, x, ny, nx, t):
                    if (ty, tx) not in held:
                        held[ty, tx] = np.zeros((t.nz, t.size, t.size)), np.zeros((t.size, t.size), np.int64)
                    held[ty, tx][0][:, rows, cols] += own[:, wr, wc]
                    held[ty, tx][1][rows, cols] += 1
                if len(held) * t.nz * t.size * t.size > HELD:
                    yield emit(held)
                    held = {}
        yield emit(held)

    def merge(table: pa.Table) -> pa.Table:
        data, n = _arrays(table, "data", -1).sum(axis=0), _arrays(table, "n", -1).sum(axis=0)
        return pa.table([_col(table, "ty").slice(0, 1), _col(table, "tx").slice(0, 1), _lists([data]), _lists([n.astype(np.int64)], pa.int64())], ["ty", "tx", "data", "n"])

    return windows.select("start_y", "start_x", "data").mapInArrow(add, SUMS).groupBy("ty", "tx").applyInArrow(merge, SUMS)


LAST = "ty long, tx long, data array<double>, last array<long>"


def scatter_set(obj: DataFrame, windows: DataFrame, ny: int, nx: int, t: Tiling) -> DataFrame:
    """(ty, tx, data): tiles with `windows` (pos_id, start_y, start_x, data) set in order of pos_id; of one id the later start, then the larger value, stays."""
    none = np.iinfo(np.int64).min

    def put(tile: tuple[np.ndarray, np.ndarray], at: tuple, value: np.ndarray, last: np.ndarray) -> None:
        data, had = tile
        wins = (last > had[at]) | ((last == had[at]) & (value > data[at]))
        data[at] = np.where(wins, value, data[at])
        had[at] = np.where(wins, last, had[at])

    def emit(held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _lists([held[k][0] for k in keys]), _lists([held[k][1] for k in keys], pa.int64())], ["ty", "tx", "data", "last"])

    def set_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            data = _arrays(batch, "data", t.nz, ny, nx)
            for pos, y, x, own in zip(_numbers(batch, "pos_id").tolist(), _numbers(batch, "start_y").tolist(), _numbers(batch, "start_x").tolist(), data):
                for ty, tx, rows, cols, wr, wc in _pieces(y, x, ny, nx, t):
                    if (ty, tx) not in held:
                        held[ty, tx] = np.zeros((t.nz, t.size, t.size)), np.full((t.nz, t.size, t.size), none)
                    value = own[:, wr, wc]
                    put(held[ty, tx], (slice(None), rows, cols), value, np.full(value.shape, pos))
                if len(held) * 2 * t.nz * t.size * t.size > HELD:
                    yield emit(held)
                    held = {}
        yield emit(held)

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema([]).empty_table()
        tile = _arrays(left, "data", -1)[0], np.full(t.nz * t.size * t.size, none)
        if right.num_rows:
            for value, last in zip(_arrays(right, "data", -1), _arrays_of_longs(right, "last")):
                known = last > none
                put(tile, (known,), value[known], last[known])
        return pa.table([_col(left, "ty").slice(0, 1), _col(left, "tx").slice(0, 1), _lists([tile[0]])], ["ty", "tx", "data"])

    partial = windows.select("pos_id", "start_y", "start_x", "data").mapInArrow(set_, LAST)
    return obj.groupBy("ty", "tx").cogroup(partial.groupBy("ty", "tx")).applyInArrow(merge, TILE)


def _arrays_of_longs(table: pa.Table, name: str) -> np.ndarray:
    got = _col(table, name)
    return got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)


def folded(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """The pixel of n that stands for index i; -1 of none."""
    if mode == "constant":
        return np.where((i >= 0) & (i < n), i, -1)
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    if mode == "wrap":
        return i % n
    p = i % (2 * n)
    return np.where(p < n, p, 2 * n - 1 - p)


def gather(obj: DataFrame, starts: DataFrame, ny: int, nx: int, t: Tiling, mode: str = "constant", cval: float = 1.0) -> DataFrame:
    """(pos_id, data of nz * ny * nx): the object under each window of `starts` (pos_id, start_y, start_x).

    Outside the object is `cval`, or the object goes on by one of the other MODES. A tile without row is `cval`.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {MODES}")
    s = t.size
    home = starts.select("pos_id", "start_y", "start_x", F.floor(F.col("start_y") / s).cast("long").alias("hy"), F.floor(F.col("start_x") / s).cast("long").alias("hx"))
    # a tile with many windows is dealt to several groups
    groups = home.groupBy("hy", "hx").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    dealt = home.join(groups, ["hy", "hx"]).withColumn("part", F.pmod(F.xxhash64("pos_id", "start_y", "start_x"), F.col("groups")).cast("int"))

    def lines(h: int, n: int, w: int) -> np.ndarray:
        return folded(np.arange(h * s, h * s + s + w - 1), n, mode)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hy, hx, groups in zip(*[_numbers(batch, c).tolist() for c in ("hy", "hx", "groups")]):
                tys = np.unique(lines(hy, t.ny, ny)[lines(hy, t.ny, ny) >= 0] // s).tolist()
                txs = np.unique(lines(hx, t.nx, nx)[lines(hx, t.nx, nx) >= 0] // s).tolist()
                rows += [(hy, hx, part, ty, tx) for part in range(groups) for ty in tys for tx in txs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["hy", "hx", "part", "ty", "tx"])

    asked = groups.mapInArrow(ask, "hy long, hx long, part long, ty long, tx long")
    sent = asked.join(obj, ["ty", "tx"]).select("hy", "hx", F.col("part").cast("int").alias("part"), "ty", "tx", "data")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema([]).empty_table()
        hy, hx = _numbers(left, "hy")[0], _numbers(left, "hx")[0]
        ys, xs = lines(hy, t.ny, ny), lines(hx, t.nx, nx)
        field = np.full((t.nz, len(ys), len(xs)), float(cval))
        if right.num_rows:
            for ty, tx, tile in zip(_numbers(right, "ty").tolist(), _numbers(right, "tx").tolist(), _arrays(right, "data", t.nz, s, s)):
                a, b = np.flatnonzero((ys >= 0) & (ys // s == ty)), np.flatnonzero((xs >= 0) & (xs // s == tx))
                field[:, a[:, None], b[None, :]] = tile[:, (ys[a] % s)[:, None], (xs[b] % s)[None, :]]
        y, x = _numbers(left, "start_y") - hy * s, _numbers(left, "start_x") - hx * s
        views = np.lib.stride_tricks.sliding_window_view(field, (ny, nx), axis=(1, 2))
        return pa.table([_col(left, "pos_id"), _lists(list(views[:, y, x].transpose(1, 0, 2, 3)))], ["pos_id", "data"])

    return dealt.select("pos_id", "start_y", "start_x", "hy", "hx", "part").groupBy("hy", "hx", "part").cogroup(sent.groupBy("hy", "hx", "part")).applyInArrow(cut, "pos_id long, data array<double>")


def window_px(windows: DataFrame, ny: int, nx: int) -> DataFrame:
    """(pos_id, wz, wy, wx, v) of packed windows."""
    k = F.col("k")
    return windows.select("pos_id", F.posexplode("data").alias("k", "v")).select("pos_id", F.floor(k / (ny * nx)).cast("long").alias("wz"), F.pmod(F.floor(k / nx), F.lit(ny)).cast("long").alias("wy"), F.pmod(k, F.lit(nx)).cast("long").alias("wx"), "v")
