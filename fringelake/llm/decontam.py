"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a re-parameterised
question has the template of its source. Windows of five canonical words (of all
words of an item that has fewer) are hash-joined between documents and benchmark. A
window of placeholders only says nothing of a template: it is no evidence, but for an
item that has no other windows, which is compared by the words themselves. A document is
contaminated by an item if one stretch of it has at least 0.8 of the item's
distinct windows and the slots agree along an alignment (in a copy they always
do): each value of the item's slots maps to one value of the document's.

So an item needs a hit among any fifth (and one more) of its distinct windows:
only the rarest fifth in the benchmark, its prefix, is joined, and a template
that many items have makes no pairs by itself. A bitmap of
the prefixes' hashes, of a bounded size, goes to the tasks that read documents;
what passes it meets the prefixes in a join, and a document's text meets the
items that it may hold, a bounded number in a group, each pair once, to be judged.

An alignment is the longest chain of equal windows that goes forward in both texts,
with the fewest shifts among equally long ones; chains of all stretches of a text are found together, word
by word, so that a page of numbers costs its words times the item's, and no more.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .session import bitmap, checkpointed
from .textkit import FOLDED, NON_ALNUM, U64, Sums, buffers, column, mix, passing, slices, word_hashes, words


@dataclass(frozen=True)
class Match:
    """window: words; similarity: least share of an item's windows; slack: how much
    longer than the item a stretch may be; agree: least share of consistent slots;
    most_bits: of the bitmap, as a power of two."""

    window: int = 5
    similarity: float = 0.8
    slack: float = 1.5
    agree: float = 0.9
    most_bits: int = 27


#: Units that follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur percent degree degrees k c f kmh mph v w kw kwh j hz mb gb"
).split()
NUMBER, NAME, UNIT = U64(0x51ED270B9F4A1D37), U64(0x7FB5D329728EA185), U64(0x2545F4914F6CDD1D)


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = words(data, np.array([0, len(raw)]), NON_ALNUM)
    return np.sort(word_hashes(data, s, e, FOLDED))


class Canonical:
    """Canonical words of a slice of texts: `h` with placeholders, `raw` without."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.row = words(data, offsets, NON_ALNUM)
        self.raw = word_hashes(data, self.start, self.end, FOLDED)
        n = len(self.raw)
        self.h = self.raw.copy()
        self.slot = np.zeros(n, bool)
        if not n:
            return
        first = data[self.start]
        number = (first >= 48) & (first <= 57)
        previous = data[np.maximum(self.start - 1, 0)]
        opens = np.r_[True, self.row[1:] != self.row[:-1]]
        # between this word and the one before: only a single blank, or a sentence's end, or something else
        single = ~opens & (previous == 32) & np.r_[False, self.start[1:] - self.end[:-1] == 1]
        follower = np.append(data, 32)[np.minimum(self.start + 1, len(data))]
        upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (follower >= 0x80) & (follower <= 0x9E) & (follower != 0x97))
        units = _unit_hashes()
        is_unit = units[np.minimum(np.searchsorted(units, self.raw), len(units) - 1)] == self.raw
        self.h[number] = NUMBER
        name = upper & single & ~number
        # a name that opens a sentence is known by standing inside one elsewhere in the text
        key = mix(self.raw + self.row.astype(U64) * U64(0x9E3779B97F4A7C15))
        name |= upper & ~number & np.isin(key, key[name])
        self.h[name] = NAME
        self.h[is_unit & np.r_[False, number[:-1]] & ~opens & ~number] = UNIT
        self.slot = self.h != self.raw

    def windows(self, size: int) -> Windows:
        """Every window of `size` words within one text."""
        n = len(self.h)
        at = np.arange(max(0, n - size + 1))
        at = at[self.row[at] == self.row[at + size - 1]] if len(at) else at
        if not len(at):
            none = np.zeros(0, U64)
            return Windows(at, none, none, np.zeros(0, bool))
        literal = np.concatenate([[0], np.cumsum(~self.slot)])
        template, own = Sums(self.h).hash(at, at + size), Sums(self.raw).hash(at, at + size)
        said = literal[at + size] > literal[at]
        return Windows(at, template, np.where(said, template, own), said)


@dataclass
class Windows:
    """First word, hash of the template, hash to meet by (of the words themselves where all are placeholders), whether a word is none."""

    at: np.ndarray
    template: np.ndarray
    key: np.ndarray
    said: np.ndarray


@dataclass
class Item:
    """An item's distinct evidence windows in order, the windows by place, and whether they are templates."""

    size: int
    evidence: np.ndarray
    places: np.ndarray
    templates: bool
    raw: np.ndarray
    slot: np.ndarray

    @staticmethod
    def of(text: str, p: Match) -> Item | None:
        """None of a text without words."""
        data, off = buffers(pa.array([text], pa.string()))
        c = Canonical(data, off)
        if not len(c.h):
            return None
        size = min(p.window, len(c.h))
        w = c.windows(size)
        some = bool(w.said.any())
        return Item(size, np.unique(w.key[w.said] if some else w.key), w.template if some else w.key, some, c.raw, c.slot)

    def span(self, p: Match) -> int:
        """Words of a stretch."""
        return int(len(self.raw) * p.slack) + p.window


#: Windows of an item that are aligned together at most, numbers of an alignment's table, and lines that are looked at before.
PIECE, TABLE, LINES = 1024, 1 << 22, 8


def _stretches(word: np.ndarray, key: np.ndarray, span: int, need: float) -> tuple[int, list[tuple[int, int]]]:
    """(most distinct keys in a stretch of `span` words, word ranges around the stretches that have `need`, those that overlap as one).

    A range goes `span` words beyond the keys, where the windows that are no evidence may be.
    """
    seen, left, best = Counter(), 0, 0
    words_, keys, found = word.tolist(), key.tolist(), []
    for right, k in enumerate(keys):
        seen[k] += 1
        while words_[right] - words_[left] > span:
            old = keys[left]
            seen[old] -= 1
            if not seen[old]:
                del seen[old]
            left += 1
        best = max(best, len(seen))
        if len(seen) >= need:
            first, last = max(0, words_[left] - span), words_[right] + span
            if found and first <= found[-1][1]:
                found[-1] = (found[-1][0], last)
            else:
                found.append((first, last))
    return best, found


def _agree(pairs: Iterable[tuple[int, int]], own: np.ndarray, item: Item, p: Match) -> bool:
    """Whether the aligned words (of the document, of the item) agree: each value of the item's slots maps to one of the document's."""
    votes = defaultdict(Counter)
    for word, place in set(pairs):
        if item.slot[place]:
            votes[int(item.raw[place])][int(own[word])] += 1
    total = sum(sum(v.values()) for v in votes.values())
    return total == 0 or sum(max(v.values()) for v in votes.values()) >= p.agree * total


def chains(keys: np.ndarray, starts: np.ndarray, steps: int, places: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each start, the best chain of (word, place) in the `steps` words from there; `keys`: of the document's words, -1 of none."""
    m = len(places)
    bits = (steps * m + 1).bit_length()
    low = (1 << bits) - 1
    before = np.zeros((steps, len(starts), m), np.int32)
    best, line = np.zeros((len(starts), m), np.int64), np.zeros((len(starts), m), np.int64)
    ids = np.arange(1, m + 1)
    for t in range(steps):
        at = starts + t
        own = np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], -1)
        line[:, 1:] = line[:, :-1].copy()
        line[:, 0] = 0
        hit = (own[:, None] == places[None, :]) & (own[:, None] >= 0)
        if not hit.any():
            continue
        other = np.zeros_like(best)
        np.maximum.accumulate(best[:, :-1], axis=1, out=other[:, 1:])
        straight, shifted = line >> bits, np.maximum((other >> bits) - 1, 0)
        along = (line > 0) & (straight >= shifted)
        before[t] = np.where(along, line, other) & low
        new = np.where(hit, ((np.where(along, straight, shifted) + m + 1) << bits) | (t * m + ids), 0)
        best = np.maximum(best, new)
        line = np.where(hit, new, line)
    out = []
    for b, start in enumerate(starts.tolist()):
        chain, at = [], int(best[b].max()) & low
        while at:
            t, place = divmod(at - 1, m)
            chain.append((start + t, place))
            at = int(before[t, b, place])
        out.append(chain[::-1])
    return out


def _aligned(keys: np.ndarray, ranges: list[tuple[int, int]], span: int, places: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Chains of the places in the word ranges, cut to overlapping stretches of twice `span` words."""
    starts = np.array([x for a, b in ranges for x in range(a, max(a + 1, b - span + 1), span)], np.int64)
    steps = min(2 * span + 1, max(b - a + 1 for a, b in ranges))
    many = max(1, TABLE // (steps * len(places)))
    for k in range(0, len(starts), many):
        yield from chains(keys, starts[k : k + many], steps, places)


def _consistent(w: Windows, ranges: list[tuple[int, int]], item: Item, need: float, own: np.ndarray, p: Match) -> bool:
    """Whether a stretch of the document is the item with consistent slots; a copy word by word is."""
    if not item.slot.any():
        return True
    names, places = np.unique(item.places, return_inverse=True)
    hashes = w.template if item.templates else w.key
    pos = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    keys = np.full(len(own), -1, np.int64)
    keys[w.at] = np.where(names[pos] == hashes, pos, -1)
    evidence = np.isin(names, item.evidence)

    def whole(chain: list[tuple[int, int]]) -> bool:
        return len(chain) >= p.similarity * len(places) and len({k for k in places[[q for _, q in chain]].tolist() if evidence[k]}) >= need

    def fits(chain: list[tuple[int, int]]) -> bool:
        return whole(chain) and _agree(((word + o, place + o) for word, place in chain for o in range(item.size)), own, item, p)

    # most copies have no shift: the lines of windows that the item has once are looked at first
    once = np.bincount(places)[places] == 1
    first = np.full(len(names), -1)
    first[places[once & evidence[places]]] = np.flatnonzero(once & evidence[places])
    met = np.flatnonzero(keys >= 0)
    met = met[first[keys[met]] >= 0]
    lines, votes = np.unique(met - first[keys[met]], return_counts=True)
    for line in lines[np.argsort(-votes, kind="stable")[:LINES]].tolist():
        place = np.arange(max(0, -line), min(len(places), len(keys) - line))
        place = place[keys[place + line] == places[place]]
        if fits(list(zip((place + line).tolist(), place.tolist()))):
            return True
    if len(places) <= PIECE:
        return any(fits(x) for x in _aligned(keys, ranges, item.span(p), places))
    # a long item is aligned in pieces, each where it has most
    longest = [max(_aligned(keys, ranges, int(PIECE * p.slack), places[k : k + PIECE]), key=len) for k in range(0, len(places), PIECE)]
    return fits([(word, place + PIECE * k) for k, x in enumerate(longest) for word, place in x])


def contaminations(c: Canonical, items: Iterable[tuple[int, str]], p: Match) -> Iterator[tuple[int, float]]:
    """(item number, share) of the items that the only text of `c` holds."""
    windows: dict[int, Windows] = {}
    for number, text in items:
        item = Item.of(text, p)
        if item is None:
            continue
        if item.size not in windows:
            windows[item.size] = c.windows(item.size)
        w = windows[item.size]
        pos = np.minimum(np.searchsorted(item.evidence, w.key), len(item.evidence) - 1)
        hit = np.flatnonzero(item.evidence[pos] == w.key)
        need = p.similarity * len(item.evidence)
        if len(np.unique(pos[hit])) < need:
            continue
        best, ranges = _stretches(w.at[hit], pos[hit], item.span(p), need)
        if ranges and _consistent(w, ranges, item, need, c.raw, p):
            yield number, best / len(item.evidence)


def _item_windows(batches: Iterator[pa.RecordBatch], p: Match) -> Iterator[pa.RecordBatch]:
    """(item, h, n, size): an item's evidence windows, how many there are, and their words."""
    for batch in batches:
        items = column(batch, "item").to_pylist()
        for at in range(0, len(items), 1024):
            rows = []
            for number, text in zip(items[at : at + 1024], column(batch, "text").slice(at, 1024).to_pylist()):
                item = Item.of(text, p)
                if item is not None:
                    rows += [(number, h, len(item.evidence), item.size) for h in item.evidence.view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], ["item", "h", "n", "size"])


def prefixes(items: DataFrame, p: Match) -> DataFrame:
    """(item, h, size): the windows, rarest in the benchmark first, of which a document must have one to have p.similarity of the item's."""
    windows = items.select("item", "text").mapInArrow(lambda it: _item_windows(it, p), "item long, h long, n long, size long")
    often = windows.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    order = Window.partitionBy("item").orderBy("items", "h")  # an item's own windows
    ranked = windows.join(often, "h").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(p.similarity) - 1e-9) + 1).select("item", "h", "size")


def _marked(batches: Iterator[pa.RecordBatch], bits: int, known: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """doc_id; and of texts with windows that pass the bitmap: these, a digest of the text, the text."""
    for batch in batches:
        texts = column(batch, "text")
        data, off = buffers(texts)
        hits: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for i, j in slices(off):
            c = Canonical(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for size in sizes:
                w = c.windows(size)
                k = passing(w.key, bits, known)
                pairs = np.unique(np.column_stack([c.row[w.at[k]].astype(U64), w.key[k]]), axis=0) if len(k) else np.zeros((0, 2), U64)
                for row, x in zip(pairs[:, 0].tolist(), pairs[:, 1].view(np.int64).tolist()):
                    hits[i + row].append(x)
        kept = [t.as_py() if x else None for t, x in zip(texts, hits)]
        digest = [hashlib.blake2b(t.encode(), digest_size=16).digest() if t is not None else None for t in kept]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(hits, pa.list_(pa.int64())), pa.array(digest, pa.binary()), pa.array(kept, pa.string())], ["doc_id", "hits", "digest", "text"])


def _verdicts(left: pa.Table, right: pa.Table, p: Match) -> pa.Table:
    """A text and some of the items that it may hold."""
    found, share = set(), 0.0
    if left.num_rows and right.num_rows:
        data, off = buffers(column(left, "text").slice(0, 1))
        pairs = sorted(zip(column(right, "item_id").to_pylist(), column(right, "item_text").to_pylist()))
        for item, s in contaminations(Canonical(data, off), pairs, p):
            found.add(item)
            share = max(share, s)
    digest = column(left, "digest").slice(0, 1).to_pylist() if found else []
    return pa.table([pa.array(digest, pa.binary()), pa.array([sorted(found)] * len(digest), pa.list_(pa.int64())), pa.array([share] * len(digest), pa.float64())], ["digest", "item_ids", "similarity"])


#: Items that a text meets in one group, about.
GROUP = 256


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Match = Match()) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, item_ids (sorted), similarity (the largest share), contaminated.

    Null and empty texts are clean; so is everything where the benchmark is
    empty; items without words match nothing; items of fewer than five words
    are one window, which longer documents may have anywhere. Long texts are judged whole. Repeated documents are judged
    each, repeated items reported once; a share or agreement at its limit (a
    tie) counts as reached. Columns other than those named are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    prefix = checkpointed(prefixes(items, p))
    bits, known = bitmap(prefix.select("h"), p.most_bits)
    sizes = sorted(r["size"] for r in prefix.select("size").distinct().collect())  # p.window of them at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = checkpointed(texts.mapInArrow(lambda it: _marked(it, bits, known, sizes), "doc_id long, hits array<long>, digest binary, text string"))
    some = marked.where("digest is not null")
    pairs = some.select("digest", F.explode("hits").alias("h")).distinct().join(prefix.select("h", "item"), "h").select(F.col("digest").alias("of"), "item").distinct()
    pairs = checkpointed(pairs)
    # a text that may hold many items meets them in several groups
    groups = pairs.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    held = pairs.join(groups, "of").withColumn("part", F.pmod(F.xxhash64("item", F.lit(7)), F.col("groups")).cast("int"))
    held = held.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").select("of", "part", "item_id", "item_text")
    once = some.select("digest", "text").dropDuplicates(["digest"]).join(groups.withColumnRenamed("of", "digest"), "digest")
    once = once.select("digest", "text", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    parts = once.groupBy("digest", "part").cogroup(held.groupBy("of", "part")).applyInArrow(lambda a, b: _verdicts(a, b, p), "digest binary, item_ids array<long>, similarity double")
    found = parts.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("similarity").alias("similarity"))
    judged = some.select("doc_id", "digest").join(checkpointed(found), "digest", "left").select("doc_id", "item_ids", "similarity")
    clean = marked.where("digest is null").select("doc_id", F.lit(None).cast("array<long>").alias("item_ids"), F.lit(None).cast("double").alias("similarity"))
    whole = judged.unionByName(clean)
    return whole.select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("item_ids").isNotNull().alias("contaminated"))
