"""Operator 11 against its definition, letter by letter."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import registry, runs
from tests.llm.test_jaccard import thue_morse


def plain(w, least=12):
    """All (start, length, period): for each period the maximal stretches, those of a smaller period left out."""
    found = {}
    n = len(w)
    for p in range(1, n // 2 + 1):
        s = 0
        while s < n - p:
            if w[s] != w[s + p]:
                s += 1
                continue
            e = s
            while e < n - p and w[e] == w[e + p]:
                e += 1
            if e - s + p >= max(least, 2 * p):
                found.setdefault((s, e - s + p), p)
            s = e
    return sorted((s, n, p) for (s, n), p in found.items())


def edit(i, w):
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (k - a) % p] for k in range(a, n)]


def digest(i, text):
    w = edit(i, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = plain(w)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    milli = 1000 * best[1] // best[2] if found else None
    return (i, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.sampled_from([2, 3, 5, 12]))
def test_runs_are_the_definition(texts, least):
    words = np.array([x for t in texts for x in t], np.uint64)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if len(words):
        got = list(zip(*(x.tolist() for x in runs.periodic_runs(words, edges, least)), strict=True))
        assert got == [(t, *r) for t, w in enumerate(texts) for r in plain(w, least)]


def test_words_are_compared_where_hashes_meet(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(60)).encode() for _ in range(6)] + [b"", b" \t", b"x"]
    want = [plain(t.decode().split()) for t in texts]

    def got():
        out = [[] for _ in texts]
        for t, *r in zip(*(x.tolist() for x in runs._runs_of(*runs.spaced(texts), 12)), strict=True):
            out[t].append(tuple(r))
        return out

    assert got() == want
    monkeypatch.setattr(runs, "byte_hashes", lambda data, start, end: np.ones(len(start), np.uint64))  # all words meet
    assert got() == want
    monkeypatch.setattr(runs.Prefixes, "same", lambda self, i, j, n: np.ones(len(i), bool))  # so do all stretches
    assert got() == want


def test_long_stretches_of_the_thue_morse_pattern():
    w = list(thue_morse(1 << 11)) + list("c" * 30) + list(thue_morse(1 << 11))
    got = runs.periodic_runs(np.array([ord(x) for x in w], np.uint64), np.array([0, len(w)]))
    assert list(zip(*(x.tolist() for x in got[1:]), strict=True)) == plain(w)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 40), (4, "a b " * 40), (None, "x\ty\x0bz " * 9), (18, "un deux trois quatre cinq six " * 3), (5, "é ü " * 6 + "q" + " é ü" * 7)]
    rows += [(i, f"w{i} " + "one two three four " * (i % 9)) for i in range(100, 160)] + [(7, "long " * 30_000 + "end " + "a b c d e " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS period")
    got = {(r["doc_id"], r["n_words"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in runs.find_runs(docs).collect()}
    assert len(got) == len(rows) - 1
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = plain(w) if len(w) < 1000 else [(0, 30_000, 1), (30_001, 45_000, 5)]
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        assert got[i, len(w), " ".join(x for k, x in enumerate(w) if k not in gone)] == found
    assert runs.find_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["documents"])
def test_query(spark, data, part):
    rows = spark.read.parquet(f"{data}/{part}.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: digest(r["doc_id"], r["text"]) for r in rows if len(r["text"] or "") < 20_000}
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in registry.QUERIES["op11_periodic_runs"](spark, data).collect()}
    assert len(got) == len(rows) and all(got[i] == x for i, x in want.items()) and any(x[1] for x in want.values())
