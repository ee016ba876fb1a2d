"""Substring dedup by Relative Lempel-Ziv parsing against indexed reference blocks.

The reference of a document is every document with a smaller id. It is indexed
by word 8-grams: each window of 50 words has an anchor (its leftmost 8-gram of
least hash), and the words around an anchor that its windows can cover are a
phrase. Equal windows have equal anchors at equal places, so a document's
phrase needs to be parsed only against the reference block of its anchor's
8-gram, where it lines up with all reference phrases that could hold a window.

Two round trips parse all documents. (1) A phrase that the reference holds
whole is one factor. (2) The other phrases whose 8-gram stands in unlike
phrases are parsed in their reference block, a suffix array of its phrases:
greedily, from the first window on, the longest factor (of 50 words at least)
that a smaller document has at the same place; after a factor, and wherever
there is none, the parse goes on at the next window, so windows across factor
boundaries are checked too. An 8-gram that stands in very many phrases (the edge
of a passage that a third of all documents have) is no block for one task:
windows there meet by themselves, each as a factor of 50 words.

Whole phrases and single windows are compared by 128 bits of BLAKE2b of their
bytes, parsed phrases word by word on bytes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import Block, Replies, Runs, answer, bits, coded, conclude, covered, dump, flags, packed, send, spread, state, values, window_runs
from .suffix_dedup import dealt, gathered
from .textkit import EXACT, SPACE, U64, Sums, mix, slices, word_hashes, words

WINDOW, GRAM = 50, 8
#: Words that a phrase has before its anchor at most, and at all.
BEFORE = WINDOW - GRAM
WIDE = BEFORE + WINDOW
PHRASES, PARSED = 1, 2
#: Unlike phrases of an 8-gram that are parsed in one reference block at most.
CROWD = 4096


class Words:
    """A block's texts as words with one blank after each; `start` of each word, `first` word of each document."""

    def __init__(self, block: Block, hashed: bool = False):
        off = block.offsets
        norm, size, counts, hashes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], np.zeros(len(block.ids), np.int64), [np.zeros(0, U64)]
        for i, j in slices(off):
            part, own = block.data[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e, rows = words(part, own, SPACE)
            size.append(e - s)
            counts[i:j] = np.bincount(rows, minlength=j - i)
            text = np.full(int((e - s + 1).sum()), 32, np.uint8)
            letters = np.ones(len(text), bool)
            letters[np.cumsum(e - s + 1) - 1] = False
            text[letters] = part[~SPACE[part]]
            norm.append(text)
            if hashed:
                hashes.append(word_hashes(part, s, e, EXACT))
        self.norm, self.hashes = np.concatenate(norm), np.concatenate(hashes)
        self.start = np.concatenate([[0], np.cumsum(np.concatenate(size) + 1)])
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def rows(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    def digests(self, low: np.ndarray, high: np.ndarray, salts: list[bytes]) -> np.ndarray:
        """(n, 2) BLAKE2b of words low..high - 1."""
        raw = memoryview(self.norm)
        got = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, salt=s).digest() for a, b, s in zip(self.start[low].tolist(), self.start[high].tolist(), salts)])
        return np.frombuffer(got, "<u8").reshape(-1, 2)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each distinct row of (n, 2) keys, entry of each row)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    s = keys[order]
    new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)]
    entry = np.empty(len(keys), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry


def around(w: Words, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = w.rows(anchor)
    return np.maximum(anchor - BEFORE, w.first[row]), np.minimum(anchor + WINDOW, w.first[row + 1])


def by_part(parts: int, *tables: tuple[np.ndarray, list[np.ndarray]]) -> dict[int, bytes]:
    """A body for each part of its rows of every table (part of each row, columns)."""
    own, none = [dict(dealt(which)) for which, _ in tables], np.zeros(0, np.int64)
    return {p: dump(*[c[k.get(p, none)] for k, (_, cols) in zip(own, tables) for c in cols]) for p in sorted({p for k in own for p in k})}


def ask_phrases(block: Block, parts: int, crowd: int) -> tuple[dict[int, bytes], bytes]:
    """Distinct phrases by digest, and by 8-gram how many unlike phrases it has here."""
    w = Words(block, hashed=True)
    n = len(w.hashes)
    grams = np.zeros(n, U64)
    at = np.arange(max(0, n - GRAM + 1))
    grams[: len(at)] = Sums(w.hashes).hash(at, at + GRAM)
    r = window_runs(grams, w.first, WINDOW, GRAM)
    low, high = around(w, r.anchor)
    key = w.digests(low, high, [bytes(x) for x in zip((r.anchor - low).tolist(), (high - low).tolist())])
    first, entry = distinct(key)
    ids = block.ids[w.rows(r.anchor)]
    phrase, least = key[first], ids[first]  # in order of doc_id, and the sort is stable
    gram, g, of_gram, unlike = np.unique(grams[r.anchor[first]], return_index=True, return_inverse=True, return_counts=True)
    here, there = (phrase[:, 0] % U64(parts)).astype(np.int32), (mix(gram) % U64(parts)).astype(np.int32)
    kept = dump(coded(r.anchor), (r.anchor - r.first).astype(np.uint8), (r.last - r.first).astype(np.uint8), entry.astype(np.int32), np.packbits(ids > least[entry]), of_gram.astype(np.int32), here, there)
    return by_part(parts, (here, [phrase[:, 0], phrase[:, 1], least]), (there, [gram, np.minimum(unlike, crowd + 1).astype(np.int64), phrase[g, 0]])), kept


def judge_phrases(bodies: list[list[np.ndarray]], crowd: int) -> list[list[np.ndarray]]:
    """For each phrase: does a smaller document have it? For each 8-gram: is it in unlike phrases, and in too many for a block?"""
    a, b, least, gram, unlike, one = (np.concatenate([x[k] for x in bodies]) for k in range(6))
    held = smaller(np.column_stack([a, b]), least)
    _, g = np.unique(gram, return_inverse=True)
    n = np.bincount(g, unlike) if len(g) else np.zeros(0)
    kinds = np.unique(np.column_stack([g.astype(U64), one]), axis=0)[:, 0].astype(np.int64) if len(g) else np.zeros(0, np.int64)
    mixed = (np.bincount(kinds, minlength=len(n)) > 1) | (np.bincount(g[unlike > 1], minlength=len(n)) > 0)
    out = [held, mixed[g], (n > crowd)[g]]
    cuts = [np.cumsum([len(x[k]) for x in bodies])[:-1] for k in (0, 3)]
    return [[*bits(x), *bits(y, z)] for x, y, z in zip(np.split(out[0], cuts[0]), np.split(out[1], cuts[1]), np.split(out[2], cuts[1]))]


def smaller(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the key stands with a smaller id too."""
    first, entry = distinct(keys)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, ids)
    return least[entry] < ids


def ask_parsed(block: Block, replies: Replies, parts: int) -> tuple[dict[int, bytes], bytes]:
    """The phrases to parse, each once a block, and the windows of crowded 8-grams."""
    steps, before, more, entry, later, of_gram, here, there = state(replies)
    anchor = values(steps)
    first = anchor - before
    last, later = first + more, np.unpackbits(later, count=len(anchor)).astype(bool)
    answers = replies.get(PHRASES, {})
    (held,) = gathered(here, answers, [bool], lambda b: flags(b[:2])[:1])
    mixed, crowded = gathered(there, answers, [bool, bool], lambda b: flags(b[2:]))
    whole = held[entry] | later  # one factor
    asked = ~whole & mixed[of_gram][entry]
    crowd = crowded[of_gram][entry]
    w = Words(block)
    k = np.flatnonzero(asked & ~crowd)
    _, one, of = np.unique(entry[k], return_index=True, return_inverse=True)
    at = anchor[k[one]]
    low, high = around(w, at)
    gram = w.digests(at, at + GRAM, [b""] * len(at))[:, 0]
    part = (gram % U64(parts)).astype(np.int32)
    begin, size = w.start[low], w.start[high] - w.start[low]
    ids = block.ids[w.rows(at)]
    phrases = {p: [gram[x], ids[x], (at - low)[x].astype(np.uint8), (first[k[one]] - low)[x].astype(np.uint8), more[k[one]][x], size[x], w.norm[spread(begin[x], size[x])]] for p, x in dealt(part)}
    c = np.flatnonzero(asked & crowd)
    windows = spread(first[c], last[c] - first[c] + 1)
    key = w.digests(windows, windows + WINDOW, [b""] * len(windows))
    f, window = distinct(key)
    ids = block.ids[w.rows(windows)]
    which = (key[f, 0] % U64(parts)).astype(np.int32)
    single = dict(dealt(which))
    none = [np.zeros(0, t) for t in (U64, np.int64, np.uint8, np.uint8, np.uint8, np.int64, np.uint8)]
    out = {}
    for p in sorted({*phrases, *single}):
        x = f[single.get(p, np.zeros(0, np.int64))]
        out[p] = dump(*phrases.get(p, none), key[x, 0], key[x, 1], ids[x])
    kept = dump(coded(first[whole]), more[whole], coded(anchor[k]), of.astype(np.int32), part, coded(windows), window.astype(np.int32), np.packbits(ids > ids[f][window]), which)
    return out, kept


def orders(gram: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Suffix arrays: the phrases in order of their words from each column on, up to BEFORE, within their 8-gram."""
    rank = np.unique(gram, return_inverse=True)[1].astype(np.int64)
    top = rank * (int(w.max(initial=0)) + 2) + 1
    out = []
    for i in range(WIDE - 1, -1, -1):
        key = top + w[:, i]
        order = np.lexsort((rank, key))
        k, r = key[order], rank[order]
        rank = np.empty(len(gram), np.int64)
        rank[order] = np.cumsum(np.r_[False, (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        if i <= BEFORE:
            out.append(order)
    return out[::-1]


def parsed(gram: np.ndarray, ids: np.ndarray, w: np.ndarray, first: np.ndarray, last: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Windows of each phrase that lie in a factor: bit c is the window from column c on.

    w: (phrases, WIDE) numbers of words, lined up at the anchor, -1 outside the
    text; windows start in columns first..last, the phrase ends before `high`.
    The greedy parses of all phrases go on together, column by column.
    """
    hits, at = np.zeros(len(gram), U64), first.copy()
    suffixes = orders(gram, w)
    for i in range(BEFORE + 1):
        here = np.flatnonzero((at == i) & (i <= last))
        if not len(here):
            continue
        order = suffixes[i]
        unlike = w[order[1:], i:] != w[order[:-1], i:]
        common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), WIDE - i)
        common[gram[order[1:]] != gram[order[:-1]]] = 0
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        own, length = ids[order], np.zeros(len(here), np.int64)
        alive, reach = np.arange(len(here)), WINDOW
        while len(alive):  # the longest factor that a smaller document has
            cut = np.r_[True, common < reach]
            least = np.minimum.reduceat(own, np.flatnonzero(cut))[np.cumsum(cut) - 1]
            rows = here[alive]
            alive = alive[(least[place[rows]] < ids[rows]) & (i + reach <= high[rows])]
            length[alive] = reach
            reach += 1
        n = np.maximum(length - WINDOW + 1, 0)  # windows that start in the factor
        hits[here] |= ((U64(1) << n.astype(U64)) - U64(1)) << U64(i)
        at[here] = i + np.maximum(n, 1)
    return hits


def judge_parsed(bodies: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    gram, ids, before, first, more, size, text, a, b, own = (np.concatenate([x[k] for x in bodies]) for k in range(10))
    cuts = np.cumsum([len(x[0]) for x in bodies])[:-1]
    hits = np.zeros(len(gram), U64)
    if len(gram):
        space = np.flatnonzero(text == 32)
        begins = np.r_[0, space[:-1] + 1]
        count = np.searchsorted(space, np.cumsum(size)) - np.searchsorted(space, np.cumsum(size) - size)
        words_ = pa.Array.from_buffers(pa.large_binary(), len(space), [None, pa.py_buffer(np.r_[begins, len(text)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
        number = pc.dictionary_encode(words_).indices.to_numpy()  # equal numbers are equal bytes
        left = BEFORE - before.astype(np.int64)
        w = np.full((len(gram), WIDE), -1, np.int64)
        w[np.repeat(np.arange(len(gram)), count), spread(left, count)] = number
        start = left + first
        hits = parsed(gram, ids, w, start, start + more, left + count)
    held = smaller(np.column_stack([a, b]), own)
    singles = np.cumsum([len(x[7]) for x in bodies])[:-1]
    return [[x, *bits(y)] for x, y in zip(np.split(hits, cuts), np.split(held, singles))]


def removed_words(block: Block, replies: Replies, n: int) -> np.ndarray:
    """Words within a factor."""
    first, more, anchor, of, part, at, window, later, which = state(replies)
    first, anchor, at = values(first), values(anchor), values(at)
    answers = replies.get(PARSED, {})
    (hits,) = gathered(part, answers, [U64], lambda b: b[:1])
    (held,) = gathered(which, answers, [bool], lambda b: flags(b[1:])[:1])
    hits = hits[of]
    own, columns = np.nonzero((hits[:, None] >> np.arange(BEFORE + 1, dtype=U64)) & U64(1))
    parse = anchor[own] - BEFORE + columns
    single = at[held[window] | np.unpackbits(later, count=len(at)).astype(bool)]
    return covered(n, np.r_[first, parse, single], np.r_[first + more, parse, single], WINDOW)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _result(block: Block, replies: Replies, text: bool) -> pa.Table:
    w = Words(block)
    gone = removed_words(block, replies, len(w.start) - 1)
    total = np.concatenate([[0], np.cumsum(gone)])
    n, removed = np.diff(w.first), total[w.first[1:]] - total[w.first[:-1]]
    raw, shas, kept = w.norm.tobytes(), [], []
    edge = w.start[w.first]
    for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        joined = raw[a : max(a, b - 1)]
        if removed[k]:
            joined = b" ".join(compress(joined.split(b" "), (~gone[w.first[k] : w.first[k + 1]]).tolist()))
        shas.append(hashlib.sha256(joined).hexdigest())
        kept.append(joined.decode("utf-8", "replace") if text else None)
    ids = pa.array(block.ids, mask=block.null)
    return pa.table([ids, pa.array(n), pa.array(removed), pa.array(shas, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup_words(docs: DataFrame, text: bool = True, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of every document.

    A null text has no words. A null doc_id counts as larger than all others,
    rows of the same doc_id never remove each other's words, and texts shorter
    than a window lose nothing. Long texts and long words are parsed like any
    other. An empty table gives no rows; other columns are not read.
    """
    blocks, parts, _ = packed(docs)
    whole = answer(send(blocks, None, PHRASES, parts, lambda b, _: ask_phrases(b, parts, crowd)), lambda x: judge_phrases(x, crowd))
    factors = answer(send(blocks, whole, PARSED, parts, lambda b, r: ask_parsed(b, r, parts)), judge_parsed)
    return conclude(blocks, factors, SCHEMA, lambda b, r: _result(b, r, text))


SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, list_aggregate(w[i:i + 49], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM p) WHERE least < doc_id),
j AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
k AS (SELECT j.doc_id, j.i, word, max(h.i) OVER (PARTITION BY j.doc_id ORDER BY j.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM j LEFT JOIN h ON j.doc_id = h.doc_id AND j.i = h.i),
a AS (SELECT doc_id, sum(CAST(gone AS INT)) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""
