"""The operators on texts against brute force on small tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fringelake.llm import blocks, decontam, pii, quality, simhash, substring_rlz, suffix_dedup, toxicity
from fringelake.llm.components import components
from fringelake.llm.textkit import NON_ALNUM, SPACE, buffers, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, host string, n long"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "é", "naïve", "x", "word", "a", "日本", "tion", "er", "re", "1", "+", "end."]
    passage = " ".join(r.choice(vocabulary) for _ in range(90))
    texts = [None, "", " \t\n ", "one", "one", "a b c", "z" * 400, "ab" * 300, "x " * 300]
    for k in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 40, 60, 200])))
        if k % 3 == 0:
            cut = r.randrange(40)
            t += r.choice([" ", "\n", "\x0b"]) + passage[cut : len(passage) - r.randrange(60)] + " " + r.choice(vocabulary)
        if k % 7 == 0:
            t = texts[-1] or t
        if k % 11 == 0 and texts[-1]:
            w = texts[-1].split()
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", 0, 1, "h", 2) for k, t in enumerate(some_texts())]
    rows += [(7, rows[7][1], None, None, None, None, None, None), (None, "no id here " * 30, "en", "s1", 1, 1, "h", 1), (3, "x " * 70, "en", "s1", 1, 1, "h", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def held(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def repeats(rows, units, size):
    """Units of each row in a window that a smaller doc_id's text has too."""
    least = {}
    for doc_id, t in rows:
        u = units(t)
        for p in range(len(u) - size + 1):
            k = tuple(u[p : p + size])
            least[k] = min(least.get(k, float("inf")), float("inf") if doc_id is None else doc_id)
    for doc_id, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for p in range(len(u) - size + 1):
            if least[tuple(u[p : p + size])] < (float("inf") if doc_id is None else doc_id):
                gone[p : p + size] = [True] * size
        yield doc_id, u, gone


@pytest.fixture(params=[1_000_000, 2_000])
def some_blocks(request, monkeypatch):
    """One block of all texts, and as many as there are tasks."""
    monkeypatch.setattr(blocks, "SMALLEST", request.param)


def test_substring_dedup(docs, some_blocks):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_rlz.dedup_words(docs, text=False).collect())
    want = []
    for doc_id, u, gone in repeats(held(docs), BLANKS.findall, 50):
        kept = " ".join(w for w, g in zip(u, gone) if not g)
        want.append((str(doc_id), len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want) and any(w[2] for w in want)


def word_digests(rows):
    for doc_id, u, gone in repeats(rows, BLANKS.findall, 50):
        yield str(doc_id), len(u), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(u, gone) if not g).encode()).hexdigest()


@pytest.mark.parametrize("crowd", [4096, 1])
def test_substring_dedup_of_long_words_and_crowded_edges(spark, some_blocks, crowd):
    """Words that differ in structure only, a passage with many unlike surroundings, and a very long text."""
    r = random.Random(9)
    thue = lambda n, a, b: "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    same = some(49)
    rows = [(0, same + " " + thue(1024, "a", "b")), (1, same + " " + thue(1024, "b", "a")), (2, same + " " + thue(1024, "a", "b"))]
    passages = [some(60), some(75), some(52)]
    for k in range(60):
        cut = r.randrange(20)
        rows.append((10 + k, some(r.randrange(9)) + " " + " ".join(passages[k % 3].split()[cut // 4 : 75 - cut]) + "\t" + some(r.randrange(9))))
    rows += [(90, some(3000) + " " + passages[0] + " " + some(2000) + " " + passages[1]), (91, "x " * 5000), (92, "y x " * 40 + "x " * 90), (93, None), (94, ""), (94, rows[20][1]), (None, rows[20][1])]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, kept_text long").repartition(3)
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_rlz.dedup_words(docs, crowd=crowd).collect())
    assert got == sorted(word_digests([(d, t or "") for d, t in rows]))


def test_suffix_dedup(docs, some_blocks):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(docs, text=False).collect())
    want = []
    for doc_id, u, gone in repeats(held(docs), lambda t: t.encode(), 50):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(doc_id), len(u), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone) if not g)).hexdigest()))
    assert got == sorted(want) and any(w[2] for w in want)
    assert suffix_dedup.dedup_bytes(docs.limit(0)).count() == 0 and substring_rlz.dedup_words(docs.limit(0)).count() == 0


def test_suffix_dedup_of_periodic_lines(spark, some_blocks):
    """Windows that hold their anchor's 24-gram at several places pick any of them, by their position modulo 64."""
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passages = [noise(120) for _ in range(40)]
    periods = ["-", "=", "ab", "x y", "lo la ", "twelve bytes", "just twenty-six of bytes.. "[:26]]
    rows = []
    for k in range(64):
        lines = [(u * 80)[: 50 + (k * 7 + n) % 27] for n, u in enumerate(periods)]
        for line in lines:
            rows.append((len(rows), noise(k) + "\n" + line + "\n" + r.choice(passages) + noise(9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.dedup_bytes(docs, text=False).collect()}
    want = {doc_id: sum(gone) for doc_id, _, gone in repeats(rows, lambda t: t.encode(), 50)}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_ranges_split_by_24_grams(spark, docs, monkeypatch):
    """More parts than ranges of the sort."""
    monkeypatch.setattr(blocks, "SMALLEST", 2_000)
    whole = sorted(map(str, suffix_dedup.dedup_bytes(docs, text=False).collect()))
    monkeypatch.setattr(suffix_dedup, "RANGES", 2)
    assert sorted(map(str, suffix_dedup.dedup_bytes(docs, text=False).collect())) == whole


def test_rows_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 7)
    m = np.random.default_rng(3).integers(97, 99, (100, 5)).astype(np.uint8)
    rows, first, entry = suffix_dedup.distinct_in_pieces(100, 5, lambda a, b: m[a:b])
    assert [r.tobytes() for r in rows] == sorted({r.tobytes() for r in m}) and (rows[entry] == m).all()
    assert all(min(np.flatnonzero((m == r).all(axis=1))) == k for r, k in zip(rows, first))


def test_loser_tree():
    r = random.Random(5)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            rows = sorted({bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randrange(1, 60))})
            lcp, rest = suffix_dedup.front_coded(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 12))
            assert suffix_dedup.decoded(lcp, rest, 12) == rows
            runs.append((lcp, rows))
        order, lcp = suffix_dedup.merged(runs, 12)
        its = [iter(s) for _, s in runs]
        out = [next(its[i]) for i in order.tolist()]
        assert out == sorted(x for _, s in runs for x in s)
        for a, b, n in zip(out, out[1:], lcp.tolist()[1:]):
            assert n == next((i for i in range(12) if a[i] != b[i]), 12)


def test_quality(spark, docs):
    base = {}
    for doc_id, t in held(docs):
        w = BLANKS.findall(t)
        lines = [x for x in t.split("\n") if BLANKS.search(x)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        inside = set()
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                inside |= set(range(i, i + 8))
        base.setdefault(doc_id, []).append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)))
    rows = quality.quality(docs).collect()
    for r in rows:
        m = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert m in base[r["doc_id"]]
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r["base_failed"] and r["kept"])
    assert len(rows) == docs.count()
    bad = spark.createDataFrame([(k, "few words" if k < 40 else "enough words here " * 10 + str(k), "bad" if k < 50 else "good") for k in range(400)], "doc_id long, text string, source string")
    assert not any(r["kept"] for r in quality.quality(bad).collect() if r["doc_id"] < 50)
    assert quality.quality(bad.limit(0)).count() == 0


def test_hosts_that_fail_beyond_doubt(spark):
    """A planted host with four times the usual failures falls; a small unlucky one, and the usual ones, stay."""
    rows = []
    for h in range(20):
        rows += [(f"h{h}", k % 10 == 0) for k in range(300 + 10 * h)]
    rows += [("planted", k % 10 < 4) for k in range(400)] + [("unlucky", k < 2) for k in range(3)] + [(None, True)] * 50
    frame = spark.createDataFrame(rows, "source string, base_failed boolean")
    got = {r["source"]: r["host_failed"] for r in quality.host_verdicts(frame, quality.Rules()).collect()}
    assert len(got) == 22 and [h for h, failed in got.items() if failed] == ["planted"]


def fingerprint(text):
    import xxhash

    w = [x.decode() for x in text.encode().lower().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, prints):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs):
    rows = held(docs)
    prints = [fingerprint(t) for _, t in rows]
    want = sorted((str(d), f"{p:016x}", str(c)) for (d, _), p, c in zip(rows, prints, closure([d for d, _ in rows], prints)))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize("most_crowded", [1 << 18, 0])
def test_crowded_buckets_keep_every_link(spark, most_crowded):
    r = random.Random(3)
    center = r.getrandbits(64)
    prints = [center]
    while len(prints) < 300:
        prints.append(r.choice(prints) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {x["node"]: x["component"] for x in components(simhash.links(frame, bucket=8, most_crowded=most_crowded)).collect()}
    want = closure(list(range(len(prints))), prints)
    groups = {}
    for p, c in zip(signed, want):
        groups.setdefault(c, set()).add(found.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_toxicity(spark):
    r = random.Random(2)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    rows = []
    for k in range(900):
        w = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        if k % 6 == 0:
            w.insert(r.randrange(len(w)), r.choice(["vile", "rotten", "odious"]))
        rows.append((k, " ".join(w), int(k % 6 == 0)))
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t, _ in rows] + [(900, None, "x", "y"), (901, "", None, None), (None, "vile", "x", "y")], "doc_id long, text string, lang string, label string")
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 903
    hits = [(x["score"], rows[x["doc_id"]][2]) for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 900]
    good = [a > b for a, y in hits if y for b, z in hits if not z]
    assert sum(good) / len(good) > 0.97
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        assert x["predicted"] == int(x["score"] >= 0.5)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {x["score"] for x in none} == {0.5}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    r = random.Random(4)
    pieces = ["a", "é", "@", ".", "b.c", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.z", "1.2.3.4", "..", "%", "\n", "@@"]
    for _ in range(4000):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_of_long_runs():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, 1)] and pii.base_spans("9" * 50_000 + ".1.1.1") == []
    assert pii.base_spans("a@" * 50_000) == [] and len(pii.base_spans("1.2.3.4 " * 20_000)) == 20_000


def test_personal_data(spark):
    """Names that stand beside one person's data in two texts at least are found with the default limits; plain words are not."""
    r = random.Random(12)
    plain = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4))) for _ in range(150)]
    some = lambda n: " ".join(r.choice(plain) for _ in range(n))
    people = [(f"Zx{a}{b}quin", f"{a}{b}.person@mail{k}.example.org") for k, (a, b) in enumerate((a, b) for a in "aeiou" for b in "bdgklm")]
    rows = []
    for name, address in people:
        rows += [(0, f"{some(9)} é {name} {some(2)} {address} {some(8)}", "x", 1) for _ in range(2)]
    rows += [(0, f"{some(30)} token = 3f9{k:02d}c0d1e2a4b5968778695a4b3c2d1e0f12345 {some(20)}", None, 2) for k in range(6)]
    rows += [(0, some(60), "x", 3) for _ in range(300)] + [(0, None, "x", None), (0, "", None, 1), (0, f"only {people[0][0]} here", "y", 1), (0, rows[0][1], "x", 1)]
    rows = [(k, t, f, c) for k, (_, t, f, c) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, clean_text int").repartition(3)
    got = {x["doc_id"]: x for x in pii.personal_data(docs).collect()}
    assert len(got) == len(rows)
    named, wrong, plain_words = 0, 0, 0
    for d, t, _, _ in rows:
        base = plain_spans(t or "")
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        spans = [x.split(":") for x in got[d]["spans"].split(",") if x]
        assert all(f"{pii.KINDS[k]}:{a}:{b}" in got[d]["spans"].split(",") for a, b, k in base)
        terms = {t[int(a) : int(b)] for k, a, b in spans if k == "term"}
        named += any(n in terms for n, _ in people)
        wrong += len(terms & set(plain))
        plain_words += len((t or "").split())
        assert ("secret" in got[d]["spans"]) == ("3f9" in (t or "")) and not terms & {"token", "only", "here"}  # a cue says nothing of a value
    assert named >= 0.9 * (2 * len(people) + 2) and wrong <= 0.001 * plain_words, (named, wrong)
    joined = pii.personal_data(docs, pii.Disclosure(block=0, most_bits=10))
    assert {x["doc_id"]: x for x in joined.collect()} == got
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    clean = {x["doc_id"]: x for x in out.collect()}
    assert people[0][1] not in clean[0]["text"] and "<EMAIL>" in clean[0]["text"] and people[0][0] not in clean[0]["text"] and clean[0]["found"] == "x"
    assert "<SECRET>" in clean[2 * len(people)]["text"] and [x["text"] for x in clean.values() if x["clean_text"] is None] == [None]
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_terms_disclose_values_and_small_sets(spark):
    """A name beside one value, or beside two that come back, is a term; a word beside ever new values of a kind is none."""
    r = random.Random(4)
    some = lambda n: " ".join("".join(r.choice("bcdfgklm") + r.choice("aeiou") for _ in range(3)) for _ in range(n))
    texts = [f"{some(9)} Solo {some(1)} first@a.example.org {some(9)}" for _ in range(3)]
    texts += [f"{some(9)} Twain {some(1)} {x} {some(9)}" for x in ("one@b.example.org", "two@b.example.org") for _ in range(3)]
    texts += [f"{some(9)} mailto {some(1)} u{k}@c{k}.example.org {some(9)}" for k in range(200)]
    texts += [f"{some(9)} ringing +1 555 01{k:02d} 99{k:02d} {some(9)}" for k in range(50)] + [some(30) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[x["doc_id"]][int(a) : int(b)] for x in pii.personal_data(docs).collect() for k, a, b in (y.split(":") for y in x["spans"].split(",") if y) if k == "term"}
    assert {"Solo", "Twain"} <= found and not found & {"mailto", "ringing"}


def test_decontamination(spark):
    r = random.Random(6)
    words_ = ["".join(r.choice("klmnopqr") for _ in range(5)) for _ in range(400)]
    item = "If a train leaves Boston at 50 mph and Maria rides for 3 hours, how far does Maria travel before the next station stop"
    other = item.replace("Boston", "Denver").replace("50", "72").replace("Maria", "Chloe").replace("3", "11")
    mixed = item.replace("Maria rides", "Chloe rides").replace("does Maria", "does Peter").replace("Boston", "Rome")
    fill = lambda n: " ".join(r.choice(words_) for _ in range(n))
    rows = [(1, fill(300) + " " + item + " " + fill(5000)), (2, fill(10) + ". " + other + "."), (3, fill(200)), (4, None), (5, ""), (6, " ".join(item.split()[:8])), (7, " ".join(fill(40) + " " + " ".join(item.split()[k : k + 6]) for k in range(0, 20, 2))), (8, fill(5) + ". " + mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, fill(30)), (12, None), (13, ""), (10, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
    assert {d for d, x in got.items() if x["contaminated"]} == {1, 2}
    assert got[1]["item_ids"] == [10]
    small = {r["doc_id"]: r["contaminated"] for r in decontam.decontaminate(docs, bench, decontam.Match(most_bits=3)).collect()}
    assert small == {d: x["contaminated"] for d, x in got.items()}
    repeated = decontam.decontaminate(docs.unionByName(docs).withColumn("hits", docs["text"]).withColumn("digest", docs["doc_id"]), bench).collect()
    assert sorted((r["doc_id"], r["contaminated"]) for r in repeated) == sorted([(d, x["contaminated"]) for d, x in got.items()] * 2)
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(docs, bench.limit(0)).collect())


UNITS = "km miles hours kg mph dollars".split()


def plain_template(text):
    """(word, typed) of a text, by a regular expression and Python strings only."""
    found = [(m[0], m.start()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    inside = {w.lower() for k, (w, at) in enumerate(found) if k and w[0].isupper() and text[at - 1] == " " and at - 1 == found[k - 1][1] + len(found[k - 1][0])}
    out = []
    for k, (w, _) in enumerate(found):
        number = w[0].isdigit()
        typed = "#" if number else "%" if w.lower() in UNITS and k and found[k - 1][0][0].isdigit() else "@" if w[0].isupper() and w.lower() in inside else None
        out.append((w.lower(), typed))
    return out


def plain_contaminated(text, item, p):
    """Every stretch by itself: windows as tuples, a quadratic longest common subsequence, slots by value."""
    a, b = plain_template(text), plain_template(item)
    size = min(p.window, len(b))
    if not b:
        return False
    cut = lambda t: [t[k : k + size] for k in range(len(t) - size + 1)]
    said = any(any(not typed for _, typed in w) for w in cut(b))
    own = lambda w: tuple(word for word, _ in w)
    name = lambda w: tuple(typed or word for word, typed in w) if said else own(w)
    key = lambda w: name(w) if any(not typed for _, typed in w) else own(w)
    evidence = {key(w) for w in cut(b) if not said or any(not typed for _, typed in w)}
    met = [key(w) for w in cut(a)]
    x, y, span = [name(w) for w in cut(a)], [name(w) for w in cut(b)], int(len(b) * p.slack) + p.window
    for start in range(len(x)):
        some = x[start : start + span + 1]
        if met[start] not in evidence or len(evidence & set(met[start : start + span + 1])) < p.similarity * len(evidence):
            continue
        if not any(typed for _, typed in b):
            return True
        n = [[0] * (len(y) + 1) for _ in range(len(some) + 1)]
        for i in range(len(some) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                n[i][j] = n[i + 1][j + 1] + 1 if some[i] == y[j] else max(n[i + 1][j], n[i][j + 1])
        i = j = 0
        chain = []
        while i < len(some) and j < len(y):
            if some[i] == y[j]:
                chain.append((i, j))
                i, j = i + 1, j + 1
            elif n[i + 1][j] >= n[i][j + 1]:
                i += 1
            else:
                j += 1
        pairs, votes = {(start + i + o, j + o) for i, j in chain for o in range(size)}, {}
        for i, j in pairs:
            if b[j][1]:
                votes.setdefault(b[j][0], []).append(a[i][0])
        total = sum(map(len, votes.values()))
        agree = sum(max(v.count(w) for w in set(v)) for v in votes.values())
        if len(chain) >= p.similarity * len(y) and len({y[j] for _, j in chain} & evidence) >= p.similarity * len(evidence) and agree >= p.agree * total:
            return True
    return False


def test_decontamination_matches_a_plain_reading(spark):
    """All pairs of 120 texts and 60 items, by code that shares nothing with the operator."""
    r = random.Random(77)
    words_ = ["".join(r.choice("klmnopqr") for _ in range(4)) for _ in range(60)]
    slots = lambda: r.choice([f"{r.randrange(2, 90)}", f"{r.randrange(2, 90)} {r.choice(UNITS)}", r.choice(["Alice", "Boris", "Chloe", "Emma"])])
    items = [" ".join(r.choice(words_) if r.random() > 0.3 else slots() for _ in range(r.choice([1, 2, 3, 4, 6, 12, 20, 30]))) for _ in range(54)]
    items += [" ".join(str(k % 2 + 1) for k in range(14)), "1 2 1 2 1 2 then add", "the sum of 3 4 5 6 7 8 9 is", "99", words_[0], "mean of 5 km"]

    def changed(item):
        swap = {w: slots().split()[0] for w in set(item.split()) if w[0].isdigit() or w[0].isupper()}
        keep = r.random() < 0.3
        out = [w if keep else swap.get(w, w) for w in item.split()]
        for _ in range(r.choice([0, 0, 1, 3])):
            out.insert(r.randrange(len(out) + 1), r.choice(words_ + ["17"]))
        return " ".join(out)

    fill = lambda n: " ".join(r.choice(words_) if r.random() > 0.1 else slots() for _ in range(n))
    texts = [f"{fill(r.randrange(30))}, {changed(r.choice(items))} {fill(r.randrange(30))}" for _ in range(120)] + [" ".join(str(k % 2 + 1) for k in range(60))]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    p = decontam.Match()
    got = {(x["doc_id"], i) for x in decontam.decontaminate(docs, bench).collect() for i in x["item_ids"]}
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if plain_contaminated(t, item, p)}
    assert len(want) > 100 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_pages_of_numbers_end():
    """A page of 20,000 numbers against items of numbers takes seconds."""
    page = " ".join(str(k % 2 + 1) for k in range(20_000)) + " sum"
    data, off = buffers(pa.array([page]))
    c, p = decontam.Canonical(data, off), decontam.Match()
    alternating = " ".join(str(k % 2 + 1) for k in range(60))
    began = time.time()
    items = [alternating, alternating.replace("2", "3"), alternating + " sum", " ".join(str(k) for k in range(60)) + " sum", page, " ".join(str(k % 7) for k in range(5000)) + " sum"]
    found = [k for k, _ in decontam.contaminations(c, enumerate(items), p)]
    assert found == [0, 2, 3, 4] and time.time() - began < 30


def test_recall_of_new_parameters(spark):
    """Generated questions with other numbers, names and units are found; texts with their words in another order are not."""
    r = random.Random(21)
    words_ = ["".join(r.choice("klmnopqr") for _ in range(5)) for _ in range(80)]
    names = ["Alice", "Boris", "Chloe", "Derek", "Emma", "Farid", "Greta"]
    units = ["km", "miles", "hours", "kg"]

    def item(k):
        q = random.Random(k)
        return [q.choice(words_) if q.random() > 0.25 else q.choice(["#", "@", "# %"]) for _ in range(q.randrange(18, 40))]

    def filled(template, seed):
        q = random.Random(seed)
        a, b = q.sample(names, 2)
        n, u = q.randrange(2, 900), q.choice(units)
        out = []
        for k, w in enumerate(template):
            w = w.replace("@", (a if k % 2 else b)).replace("#", str(n + 7 * k)).replace("%", u)
            out.append(w)
        return " ".join(out)

    templates = [item(k) for k in range(60)]
    bench = [(k, filled(t, 1000 + k)) for k, t in enumerate(templates)]
    fill = lambda n: " ".join(r.choice(words_) for _ in range(n))
    rows = [(k, f"{fill(r.randrange(60))}. and {filled(t, 5000 + k)} {fill(r.randrange(60))}") for k, t in enumerate(templates)]
    rows += [(100 + k, fill(120)) for k in range(60)] + [(200 + k, " ".join(random.Random(k).sample(filled(t, k).split(), len(filled(t, k).split())))) for k, t in enumerate(templates)]
    rows += [(300, " ".join(str(k * k) for k in range(4000)))]
    bench += [(400 + k, " ".join(str(10 * k + i) for i in range(12)) + " sum of these") for k in range(30)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    got = {x["doc_id"]: x["item_ids"] for x in decontam.decontaminate(docs, table).collect()}
    assert sum(k in got[k] for k in range(60)) >= 0.95 * 60
    assert not any(got[k] for k in got if k >= 100)


def test_decontamination_of_repeated_templates(spark):
    numbers = "Add 12 34 56 78 91 23 45 67 please now"
    shop = "The shop sells 12 red pens for 3 dollars and the shop sells 40 red pens for 9 dollars so how much do both cost"
    again = "The shop sells 12 red pens for 3 dollars and the shop sells 12 red pens for 3 dollars so how much do both cost"
    fill = " blank then some plain filling that no item of ours has in it. "
    rows = [
        (1, numbers), (2, shop), (3, fill + numbers + fill), (4, fill * 40 + shop + fill * 9),
        (5, fill + shop.replace("12", "71").replace("3 ", "8 ").replace("40", "66").replace("9 ", "5 ") + fill),  # other values
        (6, fill + shop.replace("both cost", "both really cost") + fill),  # a word put in
        (7, fill + again.replace("12", "55", 1) + fill),  # one value became two: no copy of `again`, but one of `shop`
        (8, fill + "Add 1 2 3 4 5 please now" + fill), (9, fill * 30), (10, numbers.replace("34", "99") + "." + fill + numbers),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(20, numbers), (21, shop), (22, again)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.decontaminate(docs, bench).collect()}
    assert [20 in got[k] for k in range(1, 11)] == [True, False, True, False, False, False, False, False, False, True]
    assert [21 in got[k] for k in range(1, 11)] == [False, True, False, True, True, True, True, False, False, False]
    assert not any(22 in x for x in got.values())


def test_words_match_python():
    texts = [t or "" for t in some_texts()] + ["\x0b\x0c a\x1fb \x85c"]
    data, off = buffers(pa.array(texts))
    s, e, rows = words(data, off, SPACE)
    raw = data.tobytes()
    got = [[] for _ in texts]
    for a, b, k in zip(s, e, rows):
        got[k].append(raw[a:b])
    assert got == [t.encode().split() for t in texts]
    assert len(words(data, off, NON_ALNUM)[0]) == sum(len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())) for t in texts)


@pytest.mark.parametrize("agree", [20, 31, 40, 43, 60])
def test_equal_windows_pick_equal_anchors_in_blocks_of_any_size(agree):
    """Two grams whose hashes agree in their first bits: the window's anchor doesn't depend on what else is in the block."""
    low = (1 << (64 - agree)) - 1
    window = np.full(50, (1 << 64) - 1, np.uint64)
    window[10], window[20] = np.uint64((5 << (64 - agree)) | low), np.uint64(5 << (64 - agree))
    alone = blocks.window_runs(window, np.array([0, 50]), 50, 1)
    for n in (1 << 10, 1 << 20):
        rest = np.random.default_rng(agree).integers(1 << 63, (1 << 64) - 1, n, np.uint64)
        among = blocks.window_runs(np.concatenate([rest, window]), np.array([0, n, n + 50]), 50, 1)
        assert among.anchor[-1] - n == alone.anchor[0] and among.first[-1] == n
