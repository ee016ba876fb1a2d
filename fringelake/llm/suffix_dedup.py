"""Suffix-array dedup: a common-prefix-aware distributed merge sort of text suffixes.

A sparse suffix array is sorted: of each window of 50 bytes only the suffix at
its anchor (the leftmost 24-gram of least hash in it) takes part, and only where
that 24-gram stands in another document too, which a first round trip of hashes
tells. Each block sorts its suffixes into runs without equals, front-codes them
(length of the common prefix with the one before, then the rest) and sends
ranges of them to parts. A part merges its runs with loser trees that carry
each run's common prefix with the last winner: two heads are compared by these
lengths first, and by bytes only from there on. Equal neighbours are repeats.
The keys of a part are cut into many short lanes, each with a tree of its own,
and all trees of a part play each round together in NumPy.

Two sorts are made: of the suffixes at anchors with all bytes that the anchor's
windows can cover (equal, or alike from the anchor on and so far before it: its
windows are repeats of the smallest document's), and then of those windows that
may repeat in suffixes which part from theirs after the anchor. Equality is
decided on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, Replies, Runs, answer, bits, coded, conclude, covered, dump, flags, packed, send, spread, state, values, window_runs
from .textkit import U64, buffers, column, mix, slices

SIZE, GRAM = 50, 24
LEFT = SIZE - GRAM
#: Bytes of a sorted suffix: from the anchor on, then those before it, then how many each are.
WIDTH = SIZE + LEFT + 2
SHARED, SUFFIXES, WINDOWS = 1, 2, 3
#: Ranges of the merge sort at most (more parts split a range by its 24-grams), and sampled keys a range.
RANGES, SAMPLE = 1024, 16
#: Suffixes cut out and sorted at a time.
PIECE = 1 << 18
#: Keys of a lane of the merge, about.
LANE = 64


def gram_hashes(data: np.ndarray, at: np.ndarray | slice | None = None) -> np.ndarray:
    """Hash of the GRAM bytes from each position (or from those of `at`); bytes past the end are zero."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    eight = np.ndarray((n + GRAM,), "<u8", padded, strides=(1,))  # the 8 bytes from each position
    if at is None:
        eight = eight.astype(U64)
        a, b, c = eight[:n], eight[8 : n + 8], eight[16 : n + 16]
    else:
        a, b, c = eight[at], eight[at + 8], eight[at + 16]
    h = a * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h += b
    h *= U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(31)
    h += c
    return mix(h)


def rows_at(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Matrix of the n bytes from each start."""
    if not len(start):
        return np.zeros((0, n), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, n)[start]


def strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{rows.shape[1]}")


def distinct_sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct row in sorted order, entry of each row)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = strings(rows)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.r_[True, s[1:] != s[:-1]]
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix with the row before, the bytes after it) of sorted distinct rows."""
    lcp = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        lcp[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    return lcp, rows[np.arange(rows.shape[1]) >= lcp[:, None]]


def decoded(lcp: np.ndarray, rest: np.ndarray, width: int) -> list[bytes]:
    out, last, at, raw = [], b"", 0, rest.tobytes()
    for k in lcp.tolist():
        end = at + width - k
        last = last[:k] + raw[at:end]
        out.append(last)
        at = end
    return out


class Trees:
    """Loser trees over the same runs, one a lane; each round every lane that goes on gives its next row.

    rows: all runs' rows one after the other, `lcp` their common prefixes
    within the run; low, high: (lanes, runs) ranges of rows.
    """

    def __init__(self, rows: np.ndarray, lcp: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.width, n = rows.shape[1], len(rows)
        self.stride = -(-(self.width + 8) // 8) * 8
        padded = np.zeros((n, self.stride), np.uint8)
        padded[:, : self.width] = rows
        flat = padded.ravel()
        self.eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,)) if n else np.zeros(0, U64)
        self.lcp = lcp.astype(np.int16)
        self.size = 1 << max(1, (low.shape[1] - 1).bit_length())
        more = ((0, 0), (0, self.size - low.shape[1]))
        self.at, self.end = np.pad(low, more), np.pad(high, more)
        #: common prefix of each head with its lane's last winner; an ended run loses always
        self.common = np.where(self.at < self.end, 0, -1).astype(np.int16)
        self.tree = np.zeros((len(low), self.size), np.int16)
        winners = np.broadcast_to(np.arange(self.size, dtype=np.int16), (len(low), self.size))
        lanes = np.arange(len(low))
        for half in (1 << k for k in range(self.size.bit_length() - 2, -1, -1)):
            a, b = winners[:, ::2].ravel(), winners[:, 1::2].ravel()
            won, lost = self.play(np.repeat(lanes, half), a, b)
            self.tree[:, half : 2 * half] = lost.reshape(-1, half)
            winners = won.reshape(-1, half)
        self.winner = winners[:, 0].copy()

    def play(self, lanes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(winner, loser) of each pair; the loser's common prefix becomes the one with the winner."""
        x, y = self.common[lanes, a], self.common[lanes, b]
        swap = x < y
        tie = np.flatnonzero((x == y) & (x >= 0))
        if len(tie):
            p, q = self.at[lanes[tie], a[tie]] * self.stride, self.at[lanes[tie], b[tie]] * self.stride
            reach = x[tie].astype(np.int64)
            less = np.zeros(len(tie), bool)
            still = np.arange(len(tie))
            while len(still):
                u, v = self.eight[p[still] + reach[still]], self.eight[q[still] + reach[still]]
                d = u ^ v
                same = d == 0
                bit = d & (~d + U64(1))  # the lowest set bit stands in the first byte that differs
                byte = np.where(same, 8, (np.frexp(np.where(same, U64(1), bit).astype(np.float64))[1] - 1) >> 3)
                reach[still] = np.minimum(self.width, reach[still] + byte)
                shift = np.minimum(byte, 7).astype(U64) * U64(8)
                less[still] = ~same & (((u >> shift) & U64(255)) > ((v >> shift) & U64(255)))
                still = still[same & (reach[still] < self.width)]
            swap[tie] = less  # the second is the smaller one
            loser = np.where(less, a[tie], b[tie])
            self.common[lanes[tie], loser] = reach
        return np.where(swap, b, a), np.where(swap, a, b)

    def round(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, common prefix with the lane's row before) that each of the lanes gives."""
        won = self.winner[lanes]
        row, common = self.at[lanes, won], self.common[lanes, won]
        self.at[lanes, won] = row + 1
        on = row + 1 < self.end[lanes, won]
        self.common[lanes, won] = np.where(on, self.lcp[np.minimum(row + 1, len(self.lcp) - 1)], -1)
        node = (won.astype(np.int64) + self.size) >> 1
        while self.size > 1 and node[0]:
            won, self.tree[lanes, node] = self.play(lanes, won, self.tree[lanes, node])
            node >>= 1
        self.winner[lanes] = won
        return row, common


def merge_rows(sizes: list[int], lcp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of all runs' rows, common prefix of each with the one before); equal rows stand together."""
    total = len(rows)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    keys = strings(rows)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    step = max(1, LANE // 4)
    picked = np.sort(np.concatenate([keys[a + step // 2 : b : step] for a, b in zip(begins.tolist(), ends.tolist())] + [keys[:1]]))
    splits = np.unique(picked[4::4])
    inner = np.stack([a + np.searchsorted(keys[a:b], splits) for a, b in zip(begins.tolist(), ends.tolist())], axis=1) if len(splits) else np.zeros((0, len(sizes)), np.int64)
    edges = np.concatenate([begins[None, :], inner, ends[None, :]])
    low, high = edges[:-1], edges[1:]
    each = (high - low).sum(axis=1)
    keep = np.flatnonzero(each)
    low, high, each = low[keep], high[keep], each[keep]
    out = np.cumsum(each) - each
    trees = Trees(rows, lcp, low, high)
    order, common = np.empty(total, np.int64), np.empty(total, np.uint8)
    lanes = np.argsort(-each, kind="stable")
    counts = each[lanes]
    for k in range(int(counts[0])):
        lanes = lanes[: np.searchsorted(-counts[: len(lanes)], -k, side="left")]
        row, c = trees.round(lanes)
        order[out[lanes] + k], common[out[lanes] + k] = row, c
    joints = out[1:]
    a, b = rows[order[joints - 1]], rows[order[joints]]
    unlike = a != b
    common[joints] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
    common[0] = 0
    return order, common


def merged(runs: list[tuple[np.ndarray, list[bytes]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Run of each output in order (each run's own order is kept) and its common prefix with the one before."""
    sizes = [len(s) for _, s in runs]
    rows = np.frombuffer(b"".join(b"".join(s) for _, s in runs), np.uint8).reshape(-1, width)
    order, common = merge_rows(sizes, np.concatenate([p for p, _ in runs]), rows)
    return np.searchsorted(np.cumsum(sizes), order, side="right"), common


def dealt(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its entries in order) of each part that has some."""
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.r_[True, which[order][1:] != which[order][:-1]]) if len(which) else np.zeros(0, np.int64)
    for k in np.split(order, cuts[1:]) if len(cuts) else ():
        yield int(which[k[0]]), k


def gathered(which: np.ndarray, replies: dict[int, list[np.ndarray]], kinds: list[type], read) -> list[np.ndarray]:
    """Arrays of the entries from the parts' replies; read(body) gives a part's."""
    out = [np.zeros(len(which), k) for k in kinds]
    for p, k in dealt(which):
        for x, got in zip(out, read(replies[p])):
            x[k] = got
    return out


def window_anchors(block: Block) -> Runs:
    off = block.offsets
    runs = []
    for i, j in slices(off):
        base = int(off[i])
        r = window_runs(gram_hashes(block.data[base : off[j]]), off[i : j + 1] - base, SIZE, GRAM)
        runs.append(Runs(r.first + base, r.last + base, r.anchor + base))
    return Runs.join(runs)


def pack_runs(r: Runs, *more: np.ndarray) -> bytes:
    return dump(coded(r.anchor), (r.anchor - r.first).astype(np.uint8), (r.last - r.first).astype(np.uint8), *more)


def unpack_runs(body: list[np.ndarray]) -> Runs:
    anchor = values(body[0])
    first = anchor - body[1]
    return Runs(first, first + body[2], anchor)


def rows_of(block: Block, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(block.offsets, at, side="right") - 1


def shared_message(grams: np.ndarray, several: np.ndarray, parts: int) -> dict[int, bytes]:
    """Distinct ascending gram hashes, and whether several of the block's documents have them."""
    return {p: dump(np.diff(grams[k], prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.ravel().copy(), np.packbits(several[k])) for p, k in dealt(gram_parts(grams, parts))}


def gram_parts(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> U64(8)) % U64(parts)).astype(np.int64)


def ask_shared(block: Block, parts: int) -> tuple[dict[int, bytes], bytes]:
    r = window_anchors(block)
    ids = block.ids[rows_of(block, r.anchor)]
    grams, at, entry = np.unique(gram_hashes(block.data, r.anchor) >> U64(16), return_index=True, return_inverse=True)
    several = np.zeros(len(grams), bool)
    several[entry[ids != ids[at][entry]]] = True
    return shared_message(grams, several, parts), pack_runs(r)


def suffix_rows(block: Block, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    off = block.offsets
    left, right = np.minimum(LEFT, anchor - off[row]), np.minimum(SIZE, off[row + 1] - anchor)
    low, high = max(0, int(anchor.min()) - LEFT), int(anchor.max()) + SIZE
    part = np.concatenate([np.zeros(max(0, LEFT - int(anchor.min())), np.uint8), block.data[low:high], np.zeros(SIZE, np.uint8)])
    start = anchor - int(anchor.min()) + LEFT
    m = np.empty((len(anchor), WIDTH), np.uint8)
    m[:, :SIZE] = rows_at(part, start, SIZE)
    m[:, SIZE : SIZE + LEFT] = rows_at(part, start - LEFT, LEFT)[:, ::-1]
    m[:, :SIZE][np.arange(SIZE) >= right[:, None]] = 0
    m[:, SIZE : SIZE + LEFT][np.arange(LEFT) >= left[:, None]] = 0
    m[:, -2], m[:, -1] = right + 1, left + 1
    return m


def distinct_in_pieces(n: int, width: int, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct rows, index of the first of each, entry of each of the n rows); make(a, b) cuts out rows a..b."""
    rows, first, entries = [np.zeros((0, width), np.uint8)], [np.zeros(0, np.int64)], []
    for a in range(0, n, PIECE):
        m = make(a, min(n, a + PIECE))
        k, e = distinct_sorted(m)
        entries.append(e + sum(map(len, first)))
        rows.append(m[k])
        first.append(k + a)
    rows, first = np.concatenate(rows), np.concatenate(first)
    k, e = distinct_sorted(rows)
    return rows[k], first[k], e[np.concatenate(entries)] if entries else np.zeros(0, np.int64)


def ranges(rows: np.ndarray, cuts: np.ndarray, sub: int = 1) -> np.ndarray:
    """Part of each sorted row: a frequent beginning is split by the bytes that follow, a range by its 24-grams."""
    which = np.searchsorted(cuts, strings(rows), side="right")
    if sub > 1 and len(rows):
        which = which * sub + (gram_hashes(np.ascontiguousarray(rows).ravel(), np.arange(len(rows)) * rows.shape[1]) % U64(sub)).astype(np.int64)
    return which


def run_messages(rows: np.ndarray, least: np.ndarray, which: np.ndarray) -> dict[int, bytes]:
    out = {}
    for p, k in dealt(which):
        lcp, rest = front_coded(rows[k])
        out[p] = dump(lcp, rest, least[k])
    return out


def ask_suffixes(block: Block, replies: Replies, parts: int, cuts: np.ndarray, sub: int) -> tuple[dict[int, bytes], bytes]:
    """Sorted distinct suffixes of the anchors whose 24-gram other documents have too."""
    r = unpack_runs(state(replies))
    grams, entry = np.unique(gram_hashes(block.data, r.anchor) >> U64(16), return_inverse=True)
    (known,) = gathered(gram_parts(grams, parts), replies.get(SHARED, {}), [bool], lambda body: flags(body)[:1])
    live = np.flatnonzero(known[entry])
    r = Runs(r.first[live], r.last[live], r.anchor[live])
    row = rows_of(block, r.anchor)
    suffixes, first, entry = distinct_in_pieces(len(live), WIDTH, lambda a, b: suffix_rows(block, r.anchor[a:b], row[a:b]))
    least = block.ids[row[first]]  # rows are in order of doc_id, and the sort is stable
    which = ranges(suffixes, cuts, sub)
    later = block.ids[row] > least[entry]
    return run_messages(suffixes, least, which), pack_runs(r, entry.astype(np.int32), np.packbits(later), which.astype(np.int32))


def ask_windows(block: Block, replies: Replies, cuts: np.ndarray, sub: int) -> tuple[dict[int, bytes], bytes]:
    """The windows that still can be repeats; those that are for sure stay in the state.

    A window that starts o bytes before its anchor can only repeat in a suffix
    with the same SIZE bytes from the anchor on and o alike before it, which
    the merge has told (o <= known), or in one that is alike for SIZE - o at
    least but not for all SIZE (o >= SIZE - after).
    """
    body = state(replies)
    r, s, which = unpack_runs(body[:3]), body[3].astype(np.int64), body[5].astype(np.int64)
    later = np.unpackbits(body[4], count=len(s)).astype(bool)
    held, known, unknown, after = gathered(which, replies.get(SUFFIXES, {}), [bool, np.int64, np.int64, np.int64], lambda b: [flags(b[:2])[0], *b[2:]])
    known[held] = SIZE  # more than any window's distance
    known = np.where(later, SIZE, known[s])
    low = np.maximum(r.first, r.anchor - known)
    sure = low <= r.last
    still = np.minimum(r.last, low - 1)
    k = np.flatnonzero((r.first <= still) & ((r.anchor - still <= unknown[s]) | (r.anchor - r.first >= SIZE - after[s])))
    size = still[k] - r.first[k] + 1
    at, of = spread(r.first[k], size), np.repeat(k, size)
    left = r.anchor[of] - at
    at = at[(left <= unknown[s[of]]) | (left >= SIZE - after[s[of]])]
    ids = block.ids[rows_of(block, at)]
    windows, first, entry = distinct_in_pieces(len(at), SIZE, lambda a, b: rows_at(block.data, at[a:b], SIZE))
    which = ranges(windows, cuts, sub)
    later = ids > ids[first][entry]
    kept = dump(coded(low[sure]), (r.last[sure] - low[sure]).astype(np.uint8), coded(at), entry.astype(np.int32), np.packbits(later), which.astype(np.int32))
    return run_messages(windows, ids[first], which), kept


def removed_bytes(block: Block, replies: Replies) -> np.ndarray:
    low, more, at, entry, later, which = state(replies)
    low, at = values(low), values(at)
    (held,) = gathered(which, replies.get(WINDOWS, {}), [bool], lambda body: flags(body)[:1])
    hit = at[held[entry] | np.unpackbits(later, count=len(at)).astype(bool)]
    return covered(len(block.data), np.r_[low, hit], np.r_[low + more, hit], SIZE)


def judge_shared(bodies: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    grams = [np.cumsum(np.ascontiguousarray(b[0].reshape(8, -1).T).view(U64).ravel(), dtype=U64) for b in bodies]
    several = [np.unpackbits(b[1], count=len(g)).astype(np.int64) for g, b in zip(grams, bodies)]
    _, entry, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = (count > 1)[entry] | (np.concatenate(several) > 0)
    return [bits(x) for x in np.split(shared, np.cumsum([len(g) for g in grams])[:-1])]


def _merge(bodies: list[list[np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(place of each output among all entries, common prefixes, has a smaller document the same?, sizes of the runs)."""
    sizes = [len(b[0]) for b in bodies]
    rows = np.frombuffer(b"".join(b"".join(decoded(b[0], b[1], width)) for b in bodies), np.uint8).reshape(-1, width)
    place, lcp = merge_rows(sizes, np.concatenate([b[0] for b in bodies]), rows)
    new = lcp < width
    new[:1] = True
    least = np.concatenate([b[2] for b in bodies])[place]
    smallest = np.minimum.reduceat(least, np.flatnonzero(new))[np.cumsum(new) - 1]
    return place, lcp, smallest < least, sizes


def judge_suffixes(bodies: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """For each suffix: does a smaller document have it; most bytes before the anchor that a smaller
    document has too before the same SIZE bytes (-1: none); up to which of them that is unknown; most
    bytes from the anchor on that a suffix without all of them has too. Neighbours in the merged order
    have the longest common prefixes, and those alike so far stand together."""
    place, lcp, less, sizes = _merge(bodies, WIDTH)
    new = lcp < WIDTH
    new[:1] = True
    of = np.cumsum(new) - 1
    docs = np.minimum.reduceat(np.concatenate([b[2] for b in bodies])[place], np.flatnonzero(new))
    common = lcp[new].astype(np.int64)  # of unlike suffixes with the one before
    begins = common < SIZE
    begins[:1] = True
    start = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    edge = common[start]
    edge[0] = SIZE - 1
    after = np.maximum(edge, np.r_[edge[1:], SIZE - 1])[group]
    known = np.full(len(common), -1, np.int8)
    many = np.flatnonzero((np.diff(np.r_[start, len(common)]) > 1)[group])
    near, own, got = common[many], docs[many], known[many]
    for o in range(LEFT, -1, -1) if len(many) else ():
        cut = near < SIZE + o
        cut[0] = True
        hit = (np.minimum.reduceat(own, np.flatnonzero(cut))[np.cumsum(cut) - 1] < own) & (got < 0)
        got[hit] = o
    known[many] = got
    # the parts beside this one may have more suffixes like its first and last
    unknown = np.where((group == 0) | (group == len(start) - 1), LEFT, -1).astype(np.int8)
    out = [np.empty(len(place), k) for k in (bool, np.int8, np.int8, np.int8)]
    for x, v in zip(out, (less, known[of], unknown[of], after[of])):
        x[place] = v
    cuts = np.cumsum(sizes)[:-1]
    return [[*bits(h), *rest] for h, *rest in zip(*(np.split(x, cuts) for x in out))]


def judge_windows(bodies: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    place, _, less, sizes = _merge(bodies, SIZE)
    held = np.empty(len(place), bool)
    held[place] = less
    return [bits(a) for a in np.split(held, np.cumsum(sizes)[:-1])]


def _sampled(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(column(batch, "text"))
        keys: list[bytes] = []
        for i, j in slices(off):
            part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
            at = window_runs(gram_hashes(part), own, SIZE, GRAM).anchor
            at = at[mix(gram_hashes(part, at) + U64(9)) < U64(int(share * (2**64 - 1)))] if len(at) else at
            keys += [r.tobytes() for r in rows_at(np.concatenate([part, np.zeros(SIZE, np.uint8)]), at, SIZE)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])


def split_points(docs: DataFrame, wide: int, chars: int) -> np.ndarray:
    """At most `wide` - 1 keys that part the suffixes evenly, from about SAMPLE keys a range (RANGES * SAMPLE at most)."""
    if wide < 2:
        return np.zeros(0, f"S{SIZE}")
    share = min(1.0, SAMPLE * wide * 14 / max(1, chars))  # of the anchors, about one in 14 bytes
    of_docs = min(1.0, share * 16)
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(5)), F.lit(1 << 20)) < int(of_docs * (1 << 20)) + 1)
    keys = sorted(r["key"] for r in texts.mapInArrow(lambda it: _sampled(it, share / of_docs), "key binary").collect())
    picked = [bytes(keys[len(keys) * k // wide]) for k in range(1, wide)] if keys else []
    return np.unique(np.array(picked, f"S{SIZE}")) if picked else np.zeros(0, f"S{SIZE}")


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _result(block: Block, replies: Replies, text: bool) -> pa.Table:
    gone = removed_bytes(block, replies)
    off = block.offsets
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[off[1:]] - total[off[:-1]]
    begins = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
    begins[off[:-1][off[:-1] < len(gone)]] |= gone[off[:-1][off[:-1] < len(gone)]]
    spans = np.concatenate([[0], np.cumsum(begins)])
    spans = spans[off[1:]] - spans[off[:-1]]
    shas, kept = [], []
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        own = block.data[a:b]
        raw = (own[~gone[a:b]] if removed[k] else own).tobytes()
        shas.append(hashlib.sha256(raw).hexdigest())
        kept.append(raw.decode("utf-8", "replace") if text else None)
    return pa.table([pa.array(block.ids, mask=block.null), pa.array(np.diff(off)), pa.array(removed), pa.array(spans), pa.array(shas, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def dedup_bytes(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text of every document.

    A null text is empty. A null doc_id counts as larger than all others, rows
    of the same doc_id never remove each other's bytes, and texts of fewer than
    50 bytes lose nothing. A long text is a block of its own; its suffixes are
    cut out and sorted piece by piece. An empty table gives no rows; other
    columns are not read. kept_text replaces bytes that are no whole characters
    any more.
    """
    blocks, n, chars = packed(docs)
    wide = min(n, RANGES)
    sub = -(-n // wide)
    parts = wide * sub
    cuts = split_points(docs, wide, chars)
    shared = answer(send(blocks, None, SHARED, parts, lambda b, _: ask_shared(b, parts)), judge_shared)
    suffixes = answer(send(blocks, shared, SUFFIXES, parts, lambda b, r: ask_suffixes(b, r, parts, cuts, sub)), judge_suffixes)
    windows = answer(send(blocks, suffixes, WINDOWS, parts, lambda b, r: ask_windows(b, r, cuts, sub)), judge_windows)
    return conclude(blocks, windows, SCHEMA, lambda b, r: _result(b, r, text))


SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM t),
p AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM b)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM p) WHERE least < doc_id),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM h)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT s.doc_id, s.a, s.z, substr(x, 2 * coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0))) AS before FROM s JOIN b ON s.doc_id = b.doc_id),
g AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z, string_agg(before, '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""
