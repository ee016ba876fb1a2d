"""Vector codes and clusters against loops in Python integers; archives by an independent reader."""

import gzip
import hashlib
import io
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.llm import clusters, vector_codes, vectors, warc

SCHEMA = "vec_id long, embedding array<double>, label long, code string, cluster string, body string"


def usable(rows, dims):
    return [(i, e, label) for i, e, label in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]


def first_last(i):
    return (i is None, i or 0)


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", None, "z") for r in rows], SCHEMA).repartition(3)


def plain_codes(rows, dims, parts, entries, rounds):
    kept = sorted(usable(rows, dims), key=lambda r: (*first_last(r[0]), r[1]))
    w = dims // parts
    cut = [[[math.floor(256 * v) for v in e[p * w : (p + 1) * w]] for p in range(parts)] for _, e, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for last in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda k: (gap(c[p], books[p][k]), k)) for p in range(parts)] for c in cut]
        if last < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [c[p] for c, code in zip(cut, codes) if code[p] == k]
                    if own:
                        books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum(gap(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    of_label = {}
    for (_, _, label), e in zip(kept, errors):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for entry in b for v in entry).encode()).hexdigest()
    return sorted(((i, "".join("%02x" % k for k in code), e, of_label[label], digest) for (i, _, label), code, e in zip(kept, codes, errors)), key=repr)


def plain_clusters(rows, dims, clusters, rounds):
    kept = usable(rows, dims)
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:clusters]
    whole = lambda e: [math.floor(1024 * v) for v in e]
    x, at = [whole(e) for _, e, _ in kept], [whole(e) for _, e, _ in drawn]
    for last in range(rounds + 1):
        own = [min(range(len(at)), key=lambda k: (gap(v, at[k]), k)) for v in x]
        if last < rounds:
            for k in range(len(at)):
                mine = [v for v, o in zip(x, own) if o == k]
                if mine:
                    at[k] = [sum(c) // len(mine) for c in zip(*mine)]
    far = [gap(v, at[o]) for v, o in zip(x, own)]
    of = [sum(f for f, o in zip(far, own) if o == k) for k in range(len(at))]
    return sorted(((i, o, f, of[o], sum(far), hashlib.sha256(",".join(map(str, at[o])).encode()).hexdigest()) for (i, _, _), o, f in zip(kept, own, far)), key=repr)


def awkward(dims, n=300):
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = [(k, [c + r.gauss(0, 0.3) for c in r.choice(centres)], k % 4 or None) for k in range(n)]
    grid = [(1000 + k, [float(r.randint(-1, 1)) for _ in range(dims)], None) for k in range(60)]  # ties
    same = [(2000 + k, [0.5] * dims, 7) for k in range(100)]  # a hot vector
    odd = [(5, None, 1), (6, [None] * dims, 1), (7, [float("nan")] * dims, 1), (8, [float("inf")] + [0.0] * (dims - 1), 1), (9, [1.0] * (dims - 1), 1), (10, [], 1), (11, [0.0] * (dims - 1) + [None], 2), (11, [0.0] * (dims - 1) + [float("-inf")], 2)]
    return rows + grid + same + odd + rows[:3] + [(None, [0.25] * dims, 3), (None, [0.25] * dims, None), (3, [9.0] * dims, 1)]


def test_codes_match_a_loop(spark):
    rows = awkward(8)
    for c in (vector_codes.Codes(parts=4, entries=7), vector_codes.Codes(parts=2, entries=64, rounds=3)):
        got = vector_codes.compressed(frame(spark, rows), c)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows, 8, c.parts, c.entries, c.rounds)


def test_clusters_match_a_loop(spark):
    rows = awkward(6)
    for k, rounds in ((8, 10), (1, 2), (40, 5), (5, 0)):
        got = clusters.clustered(frame(spark, rows), clusters.Clustering(clusters=k, rounds=rounds, dims=6))
        assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 6, k, rounds), (k, rounds)


def test_few_large_and_no_vectors(spark):
    few = [(2, [1.0, -2.0], 1), (1, [1e9, 2.5], None), (4, [-3e7, 1e-9], 1), (3, [0.0, -0.001], 1)]
    got = vector_codes.compressed(frame(spark, few), vector_codes.Codes(parts=2, entries=64))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(few, 2, 2, 64, 2)
    got = clusters.clustered(frame(spark, few), clusters.Clustering(clusters=2, rounds=3, dims=2))
    want = plain_clusters(few, 2, 2, 3)
    fits = lambda v: v if v < 1 << 63 else None
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, o, fits(a), fits(b), fits(c), d) for i, o, a, b, c, d in want), key=repr)
    huge = [(1, [1e300, 0.0], 1), (2, [-1e300, 0.0], 1), (3, [1.0, 1.0], 2)]
    assert {r["vec_id"]: r["error"] for r in vector_codes.compressed(frame(spark, huge), vector_codes.Codes(parts=2, entries=1, rounds=0)).collect()} == {1: 0, 2: None, 3: None}
    for none in ([], [(1, None, 1)]):
        assert vector_codes.compressed(frame(spark, none)).count() == 0
        assert clusters.clustered(frame(spark, none)).count() == 0


def test_search_leaves_most_centroids_alone():
    """Well parted vectors: bounds settle nearly all, and the rest look at a ball only; results are those of a full scan."""
    r = np.random.default_rng(3)
    centres = r.integers(-20000, 20000, (64, 16))
    x = (centres[r.integers(0, 64, 5000)] + r.integers(-900, 900, (5000, 16))).astype(np.int32)
    old = clusters.Model.of((centres + r.integers(-300, 300, centres.shape)).astype(np.int64))
    new = clusters.Model.of(centres.astype(np.int64))
    had = clusters.first_state(x, old)
    state = clusters.next_state(x, had, old.moved(new.at), new)
    full = clusters.first_state(x, new)
    assert (state.cluster == full.cluster).all() and state.scanned < 0.05 * full.scanned
    exact = np.sqrt(((x[:, None, :].astype(float) - centres[None]) ** 2).sum(2))
    own = exact[np.arange(len(x)), state.cluster]
    exact[np.arange(len(x)), state.cluster] = np.inf
    assert (state.upper >= own - 1e-9).all() and (state.lower <= exact.min(1) + 1e-9).all()


def test_whole_numbers():
    assert vectors.whole(np.array([[-0.001, 0.999, 2.0]]), 256).tolist() == [[-1, 255, 512]]
    assert vectors.whole(np.array([1e18, -1.5]), 1024).tolist() == [10**18 * 1024, -1536]
    assert vectors.whole(np.array([1.7e308]), 1024).tolist() == [int(1.7e308) * 1024]


PAGES = "page_id long, url string, html string, digest string, payload string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", "z", None) for r in rows], PAGES).repartition(4)


def page_rows():
    long, copy = "<p>" + "é日本 " * 100_000, "<html>" + "same " * 40 + "</html>"
    rows = [(k, f"http://h.org/{k}", f"<html>page {k} " + "x" * (k % 150) + "</html>") for k in range(200)]
    rows += [(300 + k, f"http://copy.net/{k}", copy) for k in range(120)]
    rows += [(500, None, long), (501, "http://a b\r\nWARC-Type: evil/", long), (502, "http://e.x/", None), (503, "http://e.x/", ""), (504, "", "\x00 raw"), (None, "http://n.x/", copy), (None, None, "n" * 150), (300, "http://again.net/", copy), (510, "http://u.x/日本", "WARC/1.1\r\n\r\n" * 20), (511, "http://u.x/", "a" * 99), (512, "http://u.x/", "a" * 99)]
    return rows


def expected(rows):
    by = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            by[html] = min(i, by.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = by.get(html)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first is not None and i != first else "response", first if first is not None and i != first else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    a = warc.Archive(file_bytes=20_000, run_bytes=5_000, gap=300)
    index = warc.written(pages(spark, page_rows()), folder + "/w", a)
    return folder + "/w", index, a


def test_archives_round_trip(spark, archive):
    folder, index, a = archive
    got = warc.records(index, folder, False, a).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(page_rows())
    assert warc.index_of(spark, folder).count() == len(page_rows())
    assert warc.archived(pages(spark, [])).count() == 0
    again = warc.archived(pages(spark, page_rows())).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, again.collect()), key=repr) == expected(page_rows())


def test_files_are_plain_archives(archive):
    """Read from the first byte to the last by another reader: every record is there once, headers are whole."""
    folder, index, _ = archive
    found = []
    names = sorted(os.listdir(folder + "/archives"))
    assert len(names) > 4
    for name in names:
        with open(f"{folder}/archives/{name}", "rb") as f:
            raw = io.BytesIO(gzip.decompress(f.read()))
        while line := raw.readline():
            assert line == b"WARC/1.1\r\n"
            fields = {}
            while (line := raw.readline()) != b"\r\n":
                k, v = line.decode().rstrip("\r\n").split(": ", 1)
                assert k not in fields
                fields[k] = v
            body = raw.read(int(fields["Content-Length"]))
            assert raw.read(4) == b"\r\n\r\n"
            if fields["WARC-Type"] != "warcinfo":
                payload = body.split(b"\r\n\r\n", 1)[1]
                assert payload == b"" if fields["WARC-Type"] == "revisit" else fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
                found.append((fields.get("X-Page-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI")))
    rows = index.select("page_id", "record_type", "url").collect()
    assert sorted(str((str(i) if i is not None else None, k, warc.uri(u))) for i, k, u in rows) == sorted(map(str, found))


def test_selected_pages(spark, archive):
    folder, index, a = archive
    text = {(i, u): h or "" for i, u, h in page_rows()}
    some = warc.selected_pages(index, folder, F.col("url").like("http://copy.net/1%") | (F.col("page_id") == 501) | F.col("page_id").between(10, 40), a).collect()
    assert len(some) == 31 + 1 + sum(f"{k}".startswith("1") for k in range(120))
    by_id = {i: h for (i, _), h in text.items()}
    assert all(bytes(r["payload"]).decode() == by_id[r["page_id"]] for r in some)
    assert warc.selected_pages(index, folder, F.lit(False), a).count() == 0


def test_reads_are_coalesced():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 40, 5), ("b", 0, 100), ("b", 100, 3)]
    assert list(warc.runs(places, 5, 50)) == [places[:3], places[3:4], places[4:5], places[5:]]
    assert list(warc.runs(places, 100, 1000)) == [places[:4], places[4:]]
    assert list(warc.runs([], 5, 50)) == []


def test_damage_is_found():
    raw = warc.record(7, "http://x/", b"payload " * 30, hashlib.sha256(b"other").hexdigest(), None, None, False, "2000-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(gzip.compress(raw))
