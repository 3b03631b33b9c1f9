"""Operator 3: held-out accuracy on planted words, the models' sums, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity as T

BAD = ["rotten", "vile", "wretch", "filthy"]


def corpus(n=900):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(1500)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary[:30]) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(3, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w)))
        if i % 5:
            labels.append((i, int(toxic) if rng.random() > 0.02 else 1))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS toxic", "2 AS words")
    got = T.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 AS text")).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held)
    assert right / len(held) > 0.95 and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_levels_sum_to_one(spark):
    docs, labels = corpus(300)
    learn = T.with_labels(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    m = T.train(learn)
    assert m.unigram.sum(1) == pytest.approx([1, 1], abs=1e-3) and (m.backoff > 0).all() and (m.backoff <= 1).all()


def test_distinct_bigrams():
    both, a, b, edges = T.bigrams([b"x y x y x", b"", b"Z!"])
    assert edges.tolist() == [0, 3, 3, 4] and len(np.unique(both)) == 4


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (4, "rotten " * 30000), (4, "rotten " * 30000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 0), (1, 1), (4, None), (None, 1), (7, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        got = T.toxicity(d, labels).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert T.toxicity(d.limit(0), some).count() == 0


def test_no_word_or_bigram_is_displaced(spark):
    """Every bigram that is frequent enough is in the model, with its own entry, though the hashes of two begin alike."""
    pairs = {}
    for i in range(20_000):  # two bigrams whose hashes have the first 21 bits in common
        text = f"x{i} y{i}"
        slot = int(T.bigrams([text.encode()])[0].max() >> np.uint64(43))
        if slot in pairs:
            break
        pairs[slot] = text
    rare, common = pairs[slot], text
    docs = [(i, f"{common} z{i % 3}", 0) for i in range(60)] + [(100 + i, f"{rare} z{i % 3}", 1) for i in range(30)]
    m = T.train(spark.createDataFrame(docs, "doc_id long, text string, toxic int"))
    both = np.concatenate([T.bigrams([t.encode()])[0] for t in (rare, common)])
    assert (T.find(m.kept, both) < len(m.kept)).all() and len(np.unique(T.find(m.kept, both))) == len(both)
    assert len(m.words) == 1 + 4 + 3 and m.unigram.shape == m.backoff.shape == (2, len(m.words) + 1)
    (plain, toxic), _ = m.likelihoods([rare.encode(), common.encode()])
    assert toxic[0] - plain[0] > 0 > toxic[1] - plain[1]


def plain_likelihoods(train, texts):
    """The same four levels from dictionaries of words: (ordinary, toxic) log-likelihood of each text."""
    import math

    pairs = lambda t: {(a, b) for w in [t.encode().lower().translate(T.PLAIN).split()] for a, b in zip([b"", *w], w, strict=False)}
    counts, texts_of, length = ({}, {}), [0, 0], [0, 0]
    for text, c in train:
        texts_of[c] += 1
        length[c] += len(text)
        for p in pairs(text):
            counts[c][p] = counts[c].get(p, 0) + 1
    scale = [min(1.0, max(1, min(length)) / max(1, n)) for n in length]
    known = set(counts[0]) | set(counts[1])
    size = len({b for _, b in known}) + 2  # the start, and any other word
    before = [{}, {}, {}]
    occurs = [{}, {}]
    for a, b in known:
        before[2][b] = before[2].get(b, 0) + 1
        for c in (0, 1):
            if (a, b) in counts[c]:
                before[c][b] = before[c].get(b, 0) + 1
                occurs[c][b] = occurs[c].get(b, 0) + counts[c][a, b]
    shared = lambda b: (before[2].get(b, 0) + 0.5) / (len(known) + 0.5 * size)
    n = [sum(before[c].values()) for c in (0, 1)]
    low = max(1.0, min(n))
    factor = [min(1.0, low / max(1.0, x)) for x in n]
    rest = [{b: max(k * factor[c] - T.CONTINUATION_DISCOUNT, 0) / max(1.0, n[c] * factor[c]) for b, k in before[c].items()} for c in (0, 1)]
    mass = [sum(r.values()) for r in rest]
    unigram = lambda c, b: rest[c].get(b, 0) * (min(mass) / mass[c] if mass[c] else 0) + (1 - min(mass)) * shared(b)
    seen = lambda c, a: texts_of[c] * scale[c] if a == b"" else max(occurs[c].get(a, 0) * scale[c], 1e-9)
    both_seen = lambda a: sum(texts_of) if a == b"" else max(occurs[0].get(a, 0) + occurs[1].get(a, 0), 1e-9)
    own, both = ({}, {}), {}
    for p in known:
        k = counts[0].get(p, 0) + counts[1].get(p, 0)
        if k > T.SHARED_DISCOUNT:
            both[p] = (k - T.SHARED_DISCOUNT) / both_seen(p[0])
            for c in (0, 1):
                own[c][p] = max(counts[c].get(p, 0) * scale[c] - T.DISCOUNT, 0) / seen(c, p[0])
    used = [{}, {}, {}]
    for p, x in both.items():
        used[2][p[0]] = used[2].get(p[0], 0) + x
        for c in (0, 1):
            used[c][p[0]] = used[c].get(p[0], 0) + own[c][p]
    out = []
    for text in texts:
        total = [0.0, 0.0]
        for a, b in pairs(text):
            alike = min(used[0].get(a, 0), used[1].get(a, 0), 0.99)
            for c in (0, 1):
                first = 0.0
                if (a, b) in both:
                    first = own[c][a, b] * (alike / used[c][a] if used[c][a] else 0) + (1 - alike) * both[a, b] / max(1, used[2][a] / 0.99)
                total[c] += math.log((1 - alike) * (1 - min(used[2].get(a, 0), 0.99)) * unigram(c, b) + first)
        out.append(total)
    return np.array(out).T


def test_against_dictionaries(spark):
    docs, labels = corpus(400)
    label = dict(labels)
    learn = [(f"{t} {'so vile a thing' if label[i] else 'so fine a thing'}", label[i]) for i, t in docs if i in label]
    m = T.train(spark.createDataFrame(learn, "text string, toxic int").repartition(3))
    texts = [t for _, t in docs[:60]] + ["", "so vile a thing", "never seen"]
    got, count = m.likelihoods([t.encode() for t in texts])
    assert np.abs(got - plain_likelihoods(learn, texts)).max() < 1e-3 * count.max()
