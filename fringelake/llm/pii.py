"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers that the base patterns find, and secrets: long strings of letters and
digits whose own entropy is high. A term (a word of letters) discloses an
entity as far as seeing it predicts a value, or a small set of values of a kind: over
all documents, the share of the term's distinct surroundings that
have the value close by is P(value | term), shrunk towards P(value) as if by
one more surrounding; log2(P(value | term) / P(value)) is what one of them
gives away. A term is protected wherever it stands if the shrunk share is above
one half and all its surroundings give away more bits than it takes to pick the
term from all that were tried, and some more: that limit follows the corpus. A
set of values counts only where each comes back, on average, so a word that stands before
ever new values (a cue such as "token" or "call") names no one and stays.

The passes: (1) entities and the terms near them; (2) the surroundings of
those terms in the whole corpus; (3) spans of every document. A term set of a bounded size goes to
the tasks; a larger one leaves a bitmap of a bounded size there, and what
passes it meets the terms in a join.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .session import bitmap, checkpointed
from .textkit import FOLDED, NON_ALNUM, SPACE, Sums, buffers, column, passing, slices, word_hashes, words

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_SECRET = re.compile(r"[A-Za-z0-9_+/-]{20,}")
#: Entities that terms can give away: the base kinds and secrets.
SECRET = len(KINDS)


@dataclass(frozen=True)
class Disclosure:
    """near: words on each side of an entity; around: words on each side of a term
    that tell its surroundings apart; support: least distinct surroundings with the
    entity; share: least shrunk P(entity | term); bits: gain over the cost of picking
    the term; again: how often each value of a set comes back, on average; secret_bits: least
    entropy of a secret; block: terms that are sent to tasks at most; most_bits: of the bitmap for more, as a power of two."""

    near: int = 6
    around: int = 3
    support: int = 2
    share: float = 0.5
    bits: float = 8.0
    again: float = 2.0
    secret_bits: float = 64.0
    shortest: int = 4
    block: int = 1 << 20
    most_bits: int = 27


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) by start, then kind; the work is linear in the text."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.end() - m.start() > 6 and (parts := m[0].split(".")) and len(parts) > 3:
                start = m.start()
                for k in range(0, len(parts) - 3, 4):
                    end = start + sum(map(len, parts[k : k + 4])) + 3
                    if all(len(x := d.lstrip("0")) < 4 and int(x or "0") < 256 for d in parts[k : k + 4]):
                        found.append((start, end, 1))
                    start = end + 1
        for m in _DIGITS.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def secret_spans(text: str, p: Disclosure) -> list[tuple[int, int, int]]:
    """Long strings of letters and digits (4 of each at least) with p.secret_bits of entropy by their own characters."""
    found = []
    for m in _SECRET.finditer(text):
        n = len(m[0])
        if len(_DIGIT.findall(m[0])) >= 4 and len(_LETTER.findall(m[0])) >= 4 and sum(k * log2(n / k) for k in Counter(m[0]).values()) >= p.secret_bits:
            found.append((m.start(), m.end(), SECRET))
    return found


def entities(text: str, p: Disclosure) -> list[tuple[int, int, int]]:
    """Base spans, and the secrets outside them."""
    base = base_spans(text)
    return sorted(base + outside(secret_spans(text, p), base), key=lambda s: (s[0], s[2]))


def outside(spans: list[tuple[int, int, int]], of: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch none `of` those (in order of their starts)."""
    starts, reach, far = [s[0] for s in of], [], 0
    for s in of:
        far = max(far, s[1])
        reach.append(far)
    return [s for s in spans if not (k := bisect_left(starts, s[1])) or reach[k - 1] <= s[0]]


class _Words:
    """The words of one slice of texts, their hashes, and hashes of their surroundings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, p: Disclosure):
        self.start, self.end, self.row = words(data, offsets, NON_ALNUM)
        self.h = word_hashes(data, self.start, self.end, FOLDED)
        digit = (data >= 48) & (data <= 57)
        self.term = self.end - self.start >= p.shortest
        if len(self.h):
            has_digit = np.add.reduceat(np.append(digit, 0).astype(np.int64), np.column_stack([self.start, self.end]).ravel())[::2] > 0
            self.term &= ~has_digit
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self._sums = Sums(self.h)
        self._around = p.around

    def surroundings(self, i: np.ndarray) -> np.ndarray:
        low = np.maximum(i - self._around, self.first[self.row[i]])
        high = np.minimum(i + self._around + 1, self.first[self.row[i] + 1])
        return self._sums.hash(low, high)


def _cooccurrences(batches: Iterator[pa.RecordBatch], p: Disclosure) -> Iterator[pa.RecordBatch]:
    """(term, entity, kind, around) of the terms near each entity."""
    for batch in _pieces(batches):
        terms, values, kinds, rounds = [], [], [], []
        for text in column(batch, "text").to_pylist():
            spans = entities(text or "", p)
            if not spans:
                continue
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            w = _Words(data, np.array([0, len(raw)]), p)
            at = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))  # the byte of each code point
            cuts = [(int(at[a]), int(at[b]), text[a:b], k) for a, b, k in spans]
            free = w.term.copy()
            for a, b, _, _ in cuts:
                free[np.searchsorted(w.start, a) : np.searchsorted(w.start, b)] = False
            for a, b, value, kind in cuts:
                j, k = np.searchsorted(w.start, a), np.searchsorted(w.start, b)
                near = np.r_[max(0, j - p.near) : j, k : min(len(w.h), k + p.near)].astype(np.int64)
                near = near[free[near]]
                terms.append(w.h[near].view(np.int64))
                rounds.append(w.surroundings(near).view(np.int64))
                key = int.from_bytes(hashlib.blake2b(value.lower().encode(), digest_size=8).digest(), "little", signed=True)
                values.append(np.full(len(near), key))
                kinds.append(np.full(len(near), kind))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cat(x)) for x in (terms, values, kinds, rounds)], ["term", "entity", "kind", "around"])


#: Which of some hashes may be those of a term set; exact or not.
Member = Callable[[np.ndarray], np.ndarray]


def _surroundings(batches: Iterator[pa.RecordBatch], member: Member, p: Disclosure, one_in: int) -> Iterator[pa.RecordBatch]:
    """Distinct (term, around) of the member terms, wherever they stand; of the surroundings one in so many, by their hash."""
    for batch in batches:
        data, off = buffers(column(batch, "text"))
        for i, j in slices(off):
            w = _Words(data[off[i] : off[j]], off[i : j + 1] - off[i], p)
            at = np.flatnonzero(w.term & member(w.h))
            term, around = w.h[at], w.surroundings(at)
            if one_in > 1:
                k = np.flatnonzero((around >> np.uint64(20)) % np.uint64(one_in) == 0)
                term, around = term[k], around[k]
            order = np.lexsort((around, term))
            term, around = term[order].view(np.int64), around[order].view(np.int64)
            new = np.r_[True, (term[1:] != term[:-1]) | (around[1:] != around[:-1])] if len(term) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(term[new]), pa.array(around[new])], ["term", "around"])


def _among(h: np.ndarray, sorted_terms: np.ndarray) -> np.ndarray:
    if not len(sorted_terms):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_terms, h), len(sorted_terms) - 1)
    return sorted_terms[at] == h


def _member(terms: DataFrame, p: Disclosure) -> tuple[Member, bool]:
    """Tells the table's terms from others, and whether it does so exactly: by their hashes, p.block at most, or by a bitmap of a bounded size."""
    if terms.count() <= p.block:
        known = np.sort(np.array([r["term"] for r in terms.select("term").collect()], np.int64).view(np.uint64))
        return lambda h: _among(h, known), True
    bits, marks = bitmap(terms.select("term"), p.most_bits)

    def may(h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        out[passing(h, bits, marks)] = True
        return out

    return may, False


def _alone(texts: DataFrame, terms: DataFrame, p: Disclosure, one_in: int) -> DataFrame:
    """(term, alone): how many distinct surroundings each term has, or one in so many of them."""
    member, exact = _member(terms, p)
    found = texts.mapInArrow(lambda it: _surroundings(it, member, p, one_in), "term long, around long").distinct()
    alone = found.groupBy("term").agg(F.count(F.lit(1)).alias("alone"))
    return checkpointed(alone if exact else alone.join(terms.select("term"), "term", "left_semi"))


#: Surroundings of which one is counted first, to leave the frequent terms out.
ONE_IN = 16


def disclosing_terms(texts: DataFrame, p: Disclosure) -> DataFrame:
    """(term): hashes of the terms that give a value, or a few values of a kind, away."""
    seen = checkpointed(texts.mapInArrow(lambda it: _cooccurrences(it, p), "term long, entity long, kind long, around long").distinct())
    blanks = F.length("text") - F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) + 1
    everything = float(texts.agg(F.sum(blanks)).first()[0] or 1)  # words of the corpus, about: any may have the entity close by
    entity = seen.groupBy("entity").agg(F.countDistinct("around").alias("of_entity"))
    single = seen.groupBy("term", "entity", "kind").agg(F.count(F.lit(1)).alias("together")).join(entity, "entity")
    single = checkpointed(single.select("term", "entity", "kind", "together", "of_entity"))
    sets = single.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("values"), F.sum("together").alias("of_values"), F.sum("of_entity").alias("of_entity")).where((F.col("values") > 1) & (F.col("of_values") >= p.again * F.col("values")))
    # one surrounding may have several values by it
    rounds = seen.join(sets.select("term", "kind"), ["term", "kind"], "left_semi").groupBy("term", "kind").agg(F.countDistinct("around").alias("together"))
    sets = sets.join(rounds, ["term", "kind"])
    named = ["term", "together", "of_entity"]
    pairs = single.select(named).unionByName(sets.select(named)).where(F.col("together") >= p.support)
    pairs = checkpointed(pairs.withColumn("before", F.least(F.lit(1.0), F.col("of_entity") / F.lit(everything))).drop("of_entity"))
    cost = log2(max(2, pairs.select("term").distinct().count())) + p.bits
    # what could not pass even if the term stood nowhere else, and what stands elsewhere too often by a part of its surroundings alone
    pairs = checkpointed(pairs.where(F.col("together") * F.log2((F.col("together") + F.col("before")) / (F.col("together") + 1) / F.col("before")) >= cost))
    share = (F.col("together") + F.col("before")) / (F.col("alone") + 1)
    some = _alone(texts, pairs.select("term").distinct(), p, ONE_IN)
    pairs = checkpointed(pairs.join(some, "term", "left").withColumn("alone", F.greatest(F.coalesce("alone", F.lit(0)), "together")).where(share > p.share).drop("alone"))
    every = _alone(texts, pairs.select("term").distinct(), p, 1)
    gain = F.col("together") * F.log2(share / F.col("before"))
    return checkpointed(pairs.join(every, "term").where((share > p.share) & (gain >= cost)).select("term").distinct())


def _term_spans(batches: Iterator[pa.RecordBatch], member: Member | None, p: Disclosure) -> Iterator[pa.RecordBatch]:
    """(text and the other columns, found): the byte spans of the member terms, or of those that a row has in `own`."""
    for batch in _pieces(batches):
        data, off = buffers(column(batch, "text"))
        own = column(batch, "own").to_pylist() if member is None else []
        out: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for i, j in slices(off):
            w = _Words(data[off[i] : off[j]], off[i : j + 1] - off[i], p)
            if member is not None:
                at = np.flatnonzero(w.term & member(w.h))
            else:
                cuts = np.searchsorted(w.row, np.arange(j - i + 1))
                at = np.concatenate([cuts[k] + np.flatnonzero((w.term & _among(w.h, np.sort(np.array(own[i + k] or [], np.int64).view(np.uint64))))[cuts[k] : cuts[k + 1]]) if own[i + k] else np.zeros(0, np.int64) for k in range(j - i)])
            for a in at.tolist():
                row = int(w.row[a])
                shift = int(off[i + row] - off[i])
                out[i + row] += [int(w.start[a]) - shift, int(w.end[a]) - shift]
        keep = [n for n in batch.schema.names if n != "own"]
        yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in keep), pa.array(out, pa.list_(pa.int64()))], [*keep, "found"])


def _held(batches: Iterator[pa.RecordBatch], member: Member, p: Disclosure) -> Iterator[pa.RecordBatch]:
    """Distinct (of, term): the digest of a text, and a term that it may hold."""
    for batch in _pieces(batches):
        data, off = buffers(column(batch, "text"))
        for i, j in slices(off):
            w = _Words(data[off[i] : off[j]], off[i : j + 1] - off[i], p)
            at = np.flatnonzero(w.term & member(w.h))
            pairs = np.unique(np.column_stack([w.row[at].astype(np.uint64), w.h[at]]), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
            of = column(batch, "of").slice(i, j - i).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([of[k] for k in pairs[:, 0].tolist()], pa.binary()), pa.array(pairs[:, 1].view(np.int64))], ["of", "term"])


def all_spans(text: str, term_bytes: list[int], p: Disclosure) -> list[tuple[int, int, int]]:
    """Entities and the protected terms outside them, in code points; kind TERM is a term."""
    spans = entities(text, p)
    if term_bytes:
        if text.isascii():
            at = term_bytes
        else:
            begins = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # code points up to each byte
            at = np.append(begins - 1, len(text))[term_bytes].tolist()
        terms = sorted((a, b, TERM) for a, b in zip(at[::2], at[1::2]))
        spans = sorted(spans + outside(terms, spans), key=lambda s: (s[0], s[2]))
    return spans


NAMES = (*KINDS, "secret", "term")
TERM = len(NAMES) - 1


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, b, k in spans)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, as Python strings take several times a batch's bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _digest(batches: Iterator[pa.RecordBatch], p: Disclosure) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        counts, shas, listed = [[] for _ in KINDS], [], []
        for text, found in zip(column(batch, "text").to_pylist(), column(batch, "found").to_pylist()):
            spans = all_spans(text or "", found or [], p)
            base = [s for s in spans if s[2] < SECRET]
            for k, c in enumerate(counts):
                c.append(sum(s[2] == k for s in base))
            shas.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            listed.append(_listed(spans))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(listed, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def _sanitised(batches: Iterator[pa.RecordBatch], p: Disclosure) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        out = []
        for text, found in zip(column(batch, "text").to_pylist(), column(batch, "found").to_pylist()):
            if text is not None:
                parts, at = [], 0
                for a, b, k in all_spans(text, found or [], p):
                    if a >= at:
                        parts += [text[at:a], f"<{NAMES[k].upper()}>"]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        keep = [n for n in batch.schema.names if n not in ("text", "found")]
        yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in keep), pa.array(out, pa.string())], [*keep, "clean_text"])


def _with_spans(docs: DataFrame, p: Disclosure, last: Callable[[Iterator[pa.RecordBatch], Disclosure], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`last` over `docs` (text and others, but no `found`) with `found`, the byte spans of protected terms.

    Terms are marked in the same Python worker as `last` runs
    in: each further step would be a further worker for every task.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    terms = disclosing_terms(docs.select("text"), p)
    member, exact = _member(terms, p)
    if exact:
        return docs.mapInArrow(lambda it: last(_term_spans(it, member, p), p), schema)
    keyed = docs.withColumn("of", F.unhex(F.sha2("text", 256)))
    held = keyed.select("text", "of").mapInArrow(lambda it: _held(it, member, p), "of binary, term long").distinct().join(terms, "term")
    own = checkpointed(held.groupBy("of").agg(F.collect_list("term").alias("own")))  # of a text: no more than its words
    return keyed.join(own, "of", "left").drop("of").mapInArrow(lambda it: last(_term_spans(it, None, p), p), schema)


def personal_data(docs: DataFrame, p: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    `spans` also has the kinds secret and term. Null and empty texts have no
    spans (the digest of an empty list); repeated rows are judged each, and
    identical surroundings count once, so copies add no evidence. The work is
    linear in a text, however long it, its words or its digit runs are. An
    empty table gives no rows; other columns are not read.
    """
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), p, _digest, f"doc_id long, {kinds}, base_sha256 string, spans string")


def sanitise(docs: DataFrame, p: Disclosure = Disclosure()) -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in angle brackets; null stays null.

    Other columns pass through, whatever their names.
    """
    at = docs.columns.index("text")
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumnRenamed(names[at], "text")
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields) if n != names[at]) + ", clean_text string"
    clean = _with_spans(plain, p, _sanitised, schema)
    return clean.select(*["clean_text" if n == names[at] else n for n in names]).toDF(*docs.columns)
