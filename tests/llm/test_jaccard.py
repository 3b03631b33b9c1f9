"""Operator 5 against brute force, with groups of copies and near copies beyond the short-list bound."""

import random
import re

from tessera.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, width, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inv = {}
    for i in sorted(sets):
        seen = set()
        for s in sets[i]:
            seen.update(inv.setdefault(s, []))
            inv[s].append(i)
        for j in seen:
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out, common = [], text(30)
    for n in (1, 2, 3, 5, 9, 11, 12, 13, 22, 40, 120, 700):
        seed = text(n)
        for _ in range(12):
            w = list(seed)
            for _ in range(rng.choice([0, 0, 1, 1, 2, n // 40 + 1])):
                w[rng.randrange(n)] = rng.choice(vocabulary)
            out.append(w)
    hot = text(130)
    for k in range(150):  # a large group of near copies, and copies of one
        w = list(hot)
        for _ in range(rng.choice([1, 2, 3, 6])):
            w[rng.randrange(130)] = f"own{k}_{rng.randrange(9)}"
        out.append(w if k % 3 else hot)
    out += [common + text(20) for _ in range(60)]
    out += [["aÉ", "x"], [], [""], ["Ké"] * 2]
    rng.shuffle(out)
    return [(i * 7 % len(out) if len(out) % 7 else i, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(out)]


def run(spark, rows, width, num):
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 AS node", "2 AS n", "3 AS component_id")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(d.repartition(5), width, num, 100).collect()}


def test_brute_force(spark):
    rows = corpus()
    for width, num in ((3, 90), (5, 80), (2, 60)):
        assert run(spark, rows, width, num) == plain(rows, width, num, 100)


def test_on_documents(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(spark, data).collect()}
    assert got == plain(rows, 3, 90, 100)


def test_odd_rows(spark):
    rows = [(1, "a b c d", "en", "s", 0), (1, "a b c d", "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "A b c d", "en", "s", 0), (5, "z " * 30000, "en", "s", 0)]
    got = [tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 3, 90, 100).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, None), (1, 2, None), (2, 0, 2), (3, 0, 3), (None, 2, None), (5, 1, 5)], key=str)
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_boundary_follows_cost():
    import numpy as np

    sizes = np.zeros(jaccard.SIZES + 1, np.int64)
    sizes[20:400] = 10
    rare, crowded = np.zeros(jaccard.SKETCH, np.int64), np.zeros(jaccard.SKETCH, np.int64)
    rare[:100_000], crowded[:2_000] = 1, 50
    assert jaccard.boundary(rare, sizes, 90, 100) < jaccard.boundary(crowded, sizes, 90, 100)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_of_the_thue_morse_pattern(spark):
    """Long words that a polynomial modulo 2^64 cannot tell apart, alone and inside texts."""
    one = thue_morse(4096)
    a, b, c = one[:2048], one[2048:], thue_morse(8192)[4096:]
    assert a != b and len({a, b, c}) == 3
    inside = [" ".join(f"t{k}" for k in range(3)) + f" {w} " + " ".join(f"t{k}" for k in range(3, 8)) for w in (a, b)]
    rows = list(enumerate([a, b, one, c, a + " ", *inside, inside[0].upper()]))
    want = plain(rows, 3, 90, 100)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 3, 90, 100).collect()}
    assert got == want and want[1][1] == 1 and want[4][1] == 0 and want[6][1] == 6 and want[7][1] == 5
    kept = {r["doc_id"] for r in jaccard.representatives(docs, 5, 80, 100).collect()}
    assert kept == {k for k, (_, x) in plain(rows, 5, 80, 100).items() if x == k}


def test_common_shingles_stand_out_of_many_rare_ones(spark, monkeypatch):
    import pyspark.sql.functions as F

    monkeypatch.setattr(jaccard, "SKETCH", 256)
    rows = spark.range(400).select(F.concat_ws(" ", F.lit("the common line of all"), *[F.concat(F.lit(f"w{k}_"), F.col("id")) for k in range(40)]).alias("text"))
    counts, sizes = jaccard.sketch(rows, 5)
    assert len(counts) == 512 and int(counts.sum()) == 400 * 41 and sizes[41] == 400
    assert counts.max() >= 400
