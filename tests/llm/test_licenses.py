"""Operator 12: phrases against plain search, notices with changed words, awkward rows."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import licenses, registry


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain(text):
    """(n_words, places of the phrases as (start, label))."""
    w = words(text)
    out = []
    for label, phrase in licenses.PHRASES:
        p = words(phrase)
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    assert licenses.lcs(a, b) == row[-1]


def test_scan(spark, tmp_path):
    bsd = next(t for label, t in licenses.NOTICES if label == "bsd").split()
    changed = bsd[:6] + ["new"] + bsd[7:12] + bsd[13:]  # a word replaced, one left out
    rows = [
        (1, "Released UNDER-the (MIT) license! under the mit license"), (2, None), (3, ""), (4, "--- !!"), (4, "--- !!"), (None, "CC BY-NC 4.0, cc by nc cc by nc"),
        (5, "x " * 5000 + "Apache License, Version 2.0" + " y" * 5000 + " licensed under the apache license version 2"), (6, " ".join(changed)), (7, " ".join(bsd[:9])),
        (8, "é under the mit licenseé under  the\x00mit\tlicense"), (9, "under the mit"), (10, " ".join([*changed, "word"] * 3)), (11, "under the mit mit license under the the mit license"),
        (12, "this work is licensed under the gnu general public license, version 3."), (13, "apache license version 20"), (14, "cc by nc " * 4000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS label", "1 AS row", "2 AS spans")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    for i, text in rows:
        n, places = plain(text)
        assert by[i]["n_words"] == n and sorted((s["start"], s["label"]) for s in by[i]["spans"] if s["exact"]) == places
    own = lambda i: {s["label"] for s in by[i]["spans"] if not s["exact"]}
    assert own(6) == {"bsd"} and own(7) == set() and own(12) == {"gpl"} and own(9) == set() and own(1) == {"mit"} and own(5) == {"apache-2"}
    assert 0.8 <= by[6]["spans"][0]["score"] < 1
    assert len([s for s in by[10]["spans"] if s["label"] == "bsd"]) == 3
    assert licenses.scan(docs.limit(0)).count() == 0


def test_own_templates(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two 3 four five six")], "doc_id long, text string")
    told = [("x", "One two THREE, four five six", True), ("y", "one two three four five six", False)]
    want = {(1, ("x", "y")), (2, ())}
    show = lambda: {(r["doc_id"], tuple(sorted(s["label"] for s in r["spans"]))) for r in licenses.scan(docs, told).collect()}
    assert show() == want
    monkeypatch.setattr(licenses, "MOST_BROADCAST", 1)  # more templates than may be broadcast
    assert show() == want


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in registry.QUERIES["op12_license_scan"](spark, data).collect()}
    assert len(got) == len(rows)
    some = 0
    for i, text in ((r["doc_id"], r["text"]) for r in rows):
        n, places = plain(text)
        r = got[i]
        labels = ",".join(sorted({x for _, x in places}))
        ends = (min(places)[0], max(places)[0]) if places else (None, None)
        assert (r["n_words"], r["n_base"], r["base_labels"], (r["first_word"], r["last_word"])) == (n, len(places), labels, ends)
        assert set(labels.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        gpl = "gnu general public license, version 3" in (text or "").lower()
        assert ("gpl" in r["labels"].split(",")) == gpl
        some += bool(places) + gpl
    assert some
