"""Operator 2 against brute force, and its kernel against the definition of a maximal repeat."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out[d] = (len(b), len(b) - len(kept), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=14), min_size=1, max_size=6), st.integers(1, 4))
def test_maximal_repeats(strings, least):
    strings = [s.encode() for s in strings]
    buffer = np.frombuffer(b"".join(strings), np.uint8)
    edges = np.cumsum([0] + [len(s) for s in strings])
    begin = np.arange(len(buffer))
    which = np.searchsorted(edges, begin, side="right") - 1
    order, length, first, last = suffix.maximal_repeats(buffer, begin, edges[which + 1], edges[which], least, 16)
    got = {(bytes(buffer[order[f] : order[f] + n]), tuple(sorted(order[f : z + 1].tolist()))) for n, f, z in zip(length, first, last, strict=True)}
    want, places = set(), {}
    for k, s in enumerate(strings):
        for i in range(len(s)):
            for j in range(i + least, len(s) + 1):
                places.setdefault(s[i:j], []).append((k, i))
    for s, at in places.items():
        if len(at) > 1:
            left = {strings[k][i - 1] if i else (k, "start") for k, i in at}
            right = {strings[k][i + len(s)] if i + len(s) < len(strings[k]) else (k, "end") for k, i in at}
            if len(left) > 1 and len(right) > 1:
                want.add((s, tuple(sorted(int(edges[k] + i) for k, i in at))))
    assert got == want


def corpus():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 84, 85, 200, 900)]
    rows, near = [], text(600)
    for i in range(120):
        parts = [text(rng.randrange(0, 90))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a : len(p) - rng.randrange(len(p) // 3)], text(rng.randrange(60))]
        rows.append((i, "".join(parts)))
    for i in range(120, 170):
        k = rng.randrange(600)
        rows.append((i, near[:k] + text(1) + near[k + 1 :] if i % 3 else near))
    rows += [(170, "ab" * 400), (171, "ab" * 300), (172, "x" * 500), (173, "x" * 49), (174, None), (175, ""), (176, near + "é" * 70), (177, "é" * 60)]
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 AS row", "2 AS n_removed", "3 AS spans")
    return {r["doc_id"]: tuple(r[1:5]) for r in suffix.dedup(d.repartition(4, "doc_id")).collect()}


def test_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)


def test_on_documents(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[1:5]) for r in suffix.query(spark, data).collect()}
    assert got == plain(rows)


def test_texts_and_odd_rows(spark):
    p = "The passage that is repeated here has well over fifty bytes in it."
    rows = [(2, p, "", "", 0), (2, p, "", "", 0), (None, "A" + p, "", "", 0), (7, "B" + p + "C", "", "", 0), (8, None, None, None, None)]
    got = suffix.dedup(spark.createDataFrame(rows, DOCS), texts=True).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=str) == sorted([(2, b""), (2, b""), (None, b"A" + p.encode()), (7, b"BC"), (8, b"")], key=str)
    assert suffix.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_groups_have_all_occurrences(spark):
    rows = corpus()
    texts = {i: (t or "").encode() for i, t in rows}
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 AS group", "2 AS length")
    groups = {}
    for r in suffix.maximal_repeat_groups(d.repartition(3, "doc_id")).collect():
        groups.setdefault((r["group"], r["length"]), set()).add((r["doc_id"], r["start"]))
    strings, covered = {}, set()
    for i, b in texts.items():
        for k in range(len(b) - 49):
            strings.setdefault(b[k : k + 50], set()).add((i, k))
    for (_, length), at in groups.items():
        i, k = next(iter(at))
        whole = texts[i][k : k + length]
        assert len(whole) == length >= 50 and len({i for i, _ in at}) > 1
        assert at == {(j, q) for j, q in strings[whole[:50]] if texts[j][q : q + length] == whole}
        covered |= {(j, q + n) for j, q in at for n in range(length - 49)}
    assert covered == {x for at in strings.values() if len({i for i, _ in at}) > 1 for x in at}
    assert suffix.maximal_repeat_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(80_000))
    rows = [(1, long), (2, "x" + long[1000:60_000] + "y"), (3, long[:49])]
    assert run(spark, rows) == plain(rows)


def test_a_task_holds_one_bucket_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    import pyspark.sql.functions as F

    from tessera.llm import suffix

    read = []

    def batches():
        for k in range(6):
            read.append(k)
            yield pa.RecordBatch.from_pydict({"bucket": [k // 2, k // 2], "n": [k, k]})

    found = [(bucket, len(rows), len(read)) for bucket, rows in suffix._by_bucket(batches())]
    assert found == [(0, 4, 3), (1, 4, 5), (2, 4, 6)]
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1000)
    assert suffix._buckets(spark.range(0, 100, 1, 1).select(F.repeat(F.lit("a"), 1000).alias("text"))) == 100
