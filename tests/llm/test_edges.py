"""One table of awkward rows through every operator: nulls in all columns, empty, blank and very long texts, ties, copies, clashing columns; and empty tables."""

import json
import random

import pytest

from fringelake.llm import chat, decontam, mixing, pii, quality, simhash, substring_rlz, suffix_dedup, toxicity, urls

LONG = 200_000


def awkward_texts():
    r = random.Random(13)
    some = " ".join(r.choice(["plain", "words", "of", "no", "account", "é", "日本"]) for _ in range(LONG // 6))
    return [None, "", " \t\n\x0b ", "x", "a" * LONG, "9" * LONG, "a " * (LONG // 2), "\n" * LONG, "1." * (LONG // 2), "@" * LONG, some, "é" * 30, "\x1f\x85  \U0001f600", "{", "null"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Each text, some rows twice, ids null, shared, negative and large; then columns that operators use themselves."""
    rows = [(k, t) for k, t in enumerate(awkward_texts())]
    rows += [rows[3], rows[6], rows[10], (None, None), (None, "x"), (-7, "x"), (2**62, rows[10][1]), (3, "another text of a shared id")]
    extra = ["score", "fp", "key", "rate", "n_words", "base_failed", "label", "at", "block", "spans", "hits", "component_id", "kept", "toxic", "x"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(d, t, None, "s" if k % 2 else None, None, *(["z"] * len(extra) if k % 3 else [None] * len(extra))) for k, (d, t) in enumerate(rows)], schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(3, 1, 0), (4, 0, 1), (6, 1, 0), (10, 1, None), (11, None, 1), (None, 1, 1), (5, None, None), (3, 1, 0), (999, 0, 0), (-7, 0, 1)]
    return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, quality int, toxic int, text string")


OPERATORS = {
    "toxicity": (lambda d, s: toxicity.toxicity(d, s), lambda x: (x["score"], x["predicted"])),
    "substring": (lambda d, s: substring_rlz.dedup_words(d), None),
    "suffix": (lambda d, s: suffix_dedup.dedup_bytes(d), None),
    "mixing": (lambda d, s: mixing.mix_rates(d, s, mixing.Mix(targets=(0.4, 0.3, 0.3))), lambda x: (x["n_tokens"], x["rate"])),
    "quality": (lambda d, s: quality.quality(d), lambda x: (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"])),
    "decontamination": (lambda d, s: decontam.decontaminate(d, s.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")), lambda x: x["contaminated"]),
    "simhash": (lambda d, s: simhash.near_duplicates(d), lambda x: x["fingerprint"]),
    "pii": (lambda d, s: pii.personal_data(d), lambda x: x["base_sha256"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, labels, name):
    """Every row has one result, and equal texts have equal ones where only the text counts."""
    operator, of_text = OPERATORS[name]
    got = operator(awkward, labels).collect()
    held = [(x["doc_id"], x["text"]) for x in awkward.select("doc_id", "text").collect()]
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(d) for d, _ in held)
    if of_text:
        ids = [d for d, _ in held]
        text = {d: t for d, t in held if ids.count(d) == 1 or [t for i, t in held if i == d] == [t] * ids.count(d)}
        results = {}
        for x in got:
            if x["doc_id"] in text:
                results.setdefault(text[x["doc_id"]] or "", set()).add(of_text(x))
        assert len(results) > 10 and all(len(v) == 1 for v in results.values())
    empty = operator(awkward.limit(0), labels)
    assert empty.count() == 0


def test_shares_out_of_reach(spark):
    """Targets outside the posteriors' hull end at the nearest shares, as a plain solver finds them."""
    import numpy as np

    q = np.array([[0.46, 0.17, 0.37], [0.4845, 0.1331, 0.3824], [0.4818, 0.1331, 0.3851], [0.4898, 0.1186, 0.3916]])
    tokens = np.array([4, 100_000, 200_000, 9])
    scored = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, q)], "n_tokens long, q array<double>")
    targets = np.array([0.4, 0.3, 0.3])
    directions = mixing.fit_rates(scored, mixing.Mix(targets=tuple(targets)))
    a = (q * tokens[:, None]).T / tokens.sum()
    b, x = a / targets[:, None], np.ones(4)
    for _ in range(50_000):
        x = np.maximum(0, x - b.T @ (b @ x - 1) / np.linalg.norm(b, 2) ** 2)
    off = lambda rate: (((a @ rate - targets) / targets) ** 2).sum()
    assert off(mixing.rates(q, directions)) <= 1.01 * off(x)


def test_measures_of_long_texts(awkward):
    """Long texts are measured whole."""
    got = {x["doc_id"]: x for x in quality.measures(awkward).collect()}
    assert (got[4]["n_words"], got[4]["word_chars"]) == (1, LONG) and (got[7]["n_words"], got[7]["n_dup_lines"]) == (0, 0)
    assert got[6]["n_words"] == got[6]["n_repeat_words"] == LONG // 2
    prints = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(awkward).collect()}
    assert prints[0] == prints[1] == prints[2] == prints[7] == ("0" * 16, 0)
    assert prints[10][0] == prints[2**62][0] and prints[10][1] == prints[2**62][1]


def test_awkward_urls(spark):
    rows = ["://", "http://", "a" * LONG, "http://" + "a" * 3_000 + ".com/en/", "http://x.com/en/" + "p" * LONG, "http://" + "b." * 2_000 + "org/es/", "http://é.example.com/en/7", "HTTP://X.COM/EN/", None, None, "http://x.com/en/?" + "q" * LONG]
    pages = spark.createDataFrame([(k // 2, u, None if k % 2 else "<" * 1000, "z", 1.0, "z") for k, u in enumerate(rows)], "page_id long, url string, html string, host string, score double, label string")
    got = [(x["page_id"], x["rule"], x["verdict"]) for x in urls.url_verdicts(pages).collect()]
    want = [None, None, None, "com/en/", "com/en/", "org/es/", "example.com/en/7", None, None, None, "com/en/"]
    assert sorted((p, str(r)) for p, r, _ in got) == sorted((k // 2, str(r)) for k, r in enumerate(want))
    assert all(v == ("allow" if r == "example.com/en/7" else "block") for _, r, v in got if r)
    assert urls.url_verdicts(pages.limit(0)).count() == 0


def test_awkward_chats(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q" * LONG}}]})
    texts = [None, "", "{", "[]", "{}", '{"tool_calls": 3}', '{"tool_calls": [null, 1, {}]}', "x" * LONG, call, call, '{"tool_call_id": null}', '{"tool_call_id": "a"}']
    rows = [(c, t, role, x, "z", "z") for c, t in ((1, 0), (None, 1), (2, None), (None, None)) for role in ("assistant", "tool", "user", None) for x in texts]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, status string, level string").repartition(3)
    got = chat.linked_chats(c).collect()
    calls = [x for x in got if x["kind"] == "call"]
    assert len(got) - len(calls) == len(rows) - 4 * 3 and len(calls) == 4 * (3 + 1 + 1)
    assert {x["status"] for x in calls if x["call_id"] is None} == {"invalid: no name"}
    assert all(json.loads(x["json"]) is not None for x in got)
    assert chat.linked_chats(chat.as_tool_traffic(c)).count() == len(rows) and chat.linked_chats(chat.as_tool_traffic(c.limit(0))).count() == 0
