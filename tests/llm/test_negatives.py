"""Operator 13 against brute force: the query, awkward rows, ties, several blocks and groups; bounds really bound."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import negatives, registry


def plain(rows, every=50, n_pos=5, n_neg=3):
    """Of rows (id, label, vector): the contract, pair by pair."""
    use = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        one = (label, [max(-(2**62), min(2**62, math.floor(256 * x))) for x in v])
        use[i] = min(use.get(i, one), one)
    out = []
    for a in sorted(use):
        if a % every:
            continue
        fit = lambda s: max(1 - 2**63, min(2**63 - 1, s))
        score = {i: fit(sum(x * y for x, y in zip(use[a][1], v, strict=False))) for i, (_, v) in use.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if use[i][0] == use[a][0]][:n_pos]:
            inside = [i for i in order if use[i][0] != use[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:n_neg]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(inside, 1)]
    return out


FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(rows, every=50, **more):
    use = negatives.usable(rows).selectExpr("id", "CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "v")
    return sorted(tuple(r[f] for f in FIELDS) for r in negatives.hard_negatives(use, use.where(f"id % {every} = 0"), **more).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9), st.integers(1, 60), st.sampled_from([3, 1000, 1 << 40]))
def test_bounds_hold(seed, d, n, size):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-size, size + 1, (n, d))
    file = negatives.Approximation(vectors)
    anchor = rng.integers(-size, size + 1, d)
    lower, upper = file.bounds(anchor)
    score = [max(1 - 2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(anchor, v, strict=True)))) for v in vectors]
    assert file.scores(anchor, np.arange(n)).tolist() == score
    assert all(a <= s <= b for a, s, b in zip(lower, score, upper, strict=True))
    rows = np.flatnonzero(rng.random(n) < 0.5)
    assert np.array_equal(file.bounds(anchor, rows)[0], lower[rows])


def test_only_some_rows_are_scored(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (10, 32))
    labels = rng.integers(0, 10, 2000)
    block = (np.arange(2000), labels, centres[labels] + rng.integers(-40, 40, (2000, 32)))
    seen = []
    scores = negatives.Approximation.scores
    monkeypatch.setattr(negatives.Approximation, "scores", lambda self, a, rows: seen.append(len(rows)) or scores(self, a, rows))
    anchors = tuple(x[:20] for x in block)
    assert len(list(negatives.nearest_alike(block, anchors, 5))) == 100
    assert sum(seen) < 0.5 * 20 * 200


@pytest.mark.parametrize("block_rows,group_anchors", [(4096, 2048), (40, 7)])
def test_awkward_rows(spark, block_rows, group_anchors):
    rng = random.Random(4)
    vector = lambda d=6: [rng.choice([-0.5, -0.1, 0.0, 0.2, 0.3, 0.5]) for _ in range(d)]
    rows = [(i, rng.choice([0, 1, 1, 2, 9]), vector()) for i in range(1, 260)]
    hot = vector()
    rows += [(1000 + i, 1 if i % 3 else 2, hot) for i in range(120)]  # one vector many times
    rows += [(0, None, vector()), (300, 1, None), (350, 1, [0.1, None, 0.2]), (400, 1, [float("nan")] * 6), (450, 1, [float("inf"), 0.0]), (None, 1, vector())]
    rows += [(500, 1, []), (550, 1, vector(3)), (600, -3, vector(9)), (650, 77, vector()), (700, 1, [1e30, -1e30]), (-50, 2, vector()), (750, 2**31 - 1, vector()), (1050, 1, hot), (1050, 0, vector())]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("vec_id", "label", "embedding", "1 AS id", "2 AS v", "3 AS block")
    exact = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    want = plain(exact)
    assert mined(table, block_rows=block_rows, group_anchors=group_anchors) == sorted(want) and len(want) > 20


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert mined(table) == []


def test_query(spark, data):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = [tuple(r[f] for f in FIELDS) for r in registry.QUERIES["op13_hard_negatives"](spark, data).collect()]
    assert sorted(got) == sorted(plain(rows)) and got
