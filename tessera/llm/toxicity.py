"""Operator 3, toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary labelled texts, interpolate four levels: the class's bigrams, the
bigrams of both classes, the class's continuation counts, those of both classes. The shared levels smooth what is rare.
Counts of the larger class are scaled down to the smaller one's size and both are discounted, and back off, alike, so that
an expression too rare to tell falls to the shared level in both models and says nothing. A text has a log-likelihood a
word in each model; their difference, in units of its standard error (one over the root of the length), is calibrated by a
logistic curve. A text counts each of its bigrams once.

The discounts are larger than Kneser-Ney's own estimate, n1 / (n1 + 2 n2) of the counts of counts. With that one, words that
by chance occur in texts of one label only drown the telling ones: measured on held-out texts, it catches a fifth at most of
those that hold two toxic words at one false alarm in a hundred, where these discounts catch more than nine tenths.

Scale: bigrams of the labelled texts are counted per task and dealt out by successor in packed blobs; continuation
counts and contexts' counts become sorted tables, one entry a distinct word or kept bigram, which are all that is broadcast.
They grow with the corpus; no count is capped and no two words or bigrams share an entry. Scoring is one scan. The curve alone is fitted on a bounded
sample of labelled rows (``CALIBRATION_ROWS``). Labels are broadcast up to ``MOST_LABELS`` rows, else joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, as_bytes, bound_batches, buckets_for, crc_mod, deal, mix, portions, save, tidied, word_hashes

KEPT_ROW = [("both", "<u8"), ("a", "<u8"), ("c0", "<f4"), ("c1", "<f4")]
DISCOUNT, CONTINUATION_DISCOUNT, SHARED_DISCOUNT = 10.0, 10.0, 5.0
CALIBRATION_ROWS = 20_000
MOST_LABELS = 1_000_000
#: ASCII letters and digits and all other bytes over 127 make words; the rest separates them.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def bigrams(texts: list[bytes]):
    """(bigram hash, hash of the first word, hash of the second, edges) of the distinct bigrams of each text, in lower
    case; the first word follows the start of the text (hash 0 of no word). A text counts an expression once: one that
    it repeats a hundred times is no more evidence, neither when learning nor when scoring."""
    h, edges, *_ = word_hashes([t.lower().translate(PLAIN) for t in texts])
    before = np.concatenate([h[:1], h[:-1]])
    before[edges[:-1][np.diff(edges) > 0]] = U64(0)
    both, text = mix(before * U64(3) + h), np.repeat(np.arange(len(texts)), np.diff(edges))
    order = np.lexsort((both, text))
    both, text = both[order], text[order]
    new = np.concatenate([[True], (both[1:] != both[:-1]) | (text[1:] != text[:-1])]) if len(both) else np.zeros(0, bool)
    order = order[new]
    return both[new], before[order], h[order], np.searchsorted(text[new], np.arange(len(texts) + 1))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of hashes among sorted keys; of those that are not there the place after the last."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[keys[np.minimum(at, len(keys) - 1)] != wanted] = len(keys)
    return at


@dataclass
class Model:
    """Of each array of values the last entry stands for whatever has none."""

    words: np.ndarray  # sorted hashes
    unigram: np.ndarray  # class x word: probability of a word by continuation, backed off to the shared level
    backoff: np.ndarray  # class x word: weight of the lower level after a word
    kept: np.ndarray  # sorted hashes of bigrams
    first: np.ndarray  # class x bigram: discounted probability of the bigram

    def likelihoods(self, texts: list[bytes]):
        """(log-likelihoods in the ordinary and the toxic model, distinct bigrams) of each text."""
        total, count = np.zeros((2, len(texts))), np.zeros(len(texts), np.int64)
        for lo, hi in portions([len(t) for t in texts]):
            both, a, b, edges = bigrams(texts[lo:hi])
            some, place = np.unique(b, return_inverse=True)
            a, b, at = find(self.words, a), find(self.words, some)[place], find(self.kept, both)
            for c in (0, 1):
                p = np.log(self.backoff[c][a] * self.unigram[c][b] + self.first[c][at], dtype=np.float64)
                sums = np.concatenate([[0], np.cumsum(p)])
                total[c, lo:hi] = sums[edges[1:]] - sums[edges[:-1]]
            count[lo:hi] = np.diff(edges)
        return total, count


def _count(labelled: DataFrame, buckets: int) -> DataFrame:
    """Bigram counts of each task, dealt out by the second word's hash: packed bigrams, words and counts by class."""

    def scan(batches):
        held, amount = [], 0

        def flush():
            both, a, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(both, kind="stable")
            both = both[order]
            new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            n = np.diff(np.append(new, len(both)))
            toxic = np.add.reduceat(c[order], new)
            both, a, b = both[new], a[order[new]], b[order[new]]
            parts = deal((b % U64(buckets)).astype(np.int64), buckets, both, a, b, (n - toxic).astype(np.int32), toxic.astype(np.int32))
            rows = list(zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, [pa.int32()] + [pa.binary()] * 5, strict=True)], ["bucket", "both", "a", "b", "plain", "toxic"])

        for batch in batches:
            texts, toxic = as_bytes(batch.column("text")), np.array(batch.column("toxic"), np.int64)
            for lo, hi in portions([len(t) for t in texts]):
                both, a, b, edges = bigrams(texts[lo:hi])
                if len(both):
                    held.append((both, a, b, np.repeat(toxic[lo:hi].astype(np.int32), np.diff(edges))))
                    amount += len(both)
                if amount > 300_000:
                    yield flush()
                    amount = 0
        if amount:
            yield flush()

    return labelled.mapInArrow(tidied(scan), "bucket int, both binary, a binary, b binary, plain binary, toxic binary").repartition(buckets, "bucket")


def train(labelled: DataFrame, discount: float = DISCOUNT, continuation: float = CONTINUATION_DISCOUNT) -> Model:
    """The models of (text, toxic) rows."""
    grouped = labelled.where("toxic in (0, 1)").groupBy("toxic").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("texts")).collect()
    sizes, texts_of = {r["toxic"]: r["n"] or 0 for r in grouped}, {r["toxic"]: r["texts"] for r in grouped}
    small = max(1, min(sizes.get(0, 0), sizes.get(1, 0)))
    scale = [min(1.0, small / max(1, sizes.get(c, 0))) for c in (0, 1)]
    buckets = buckets_for(labelled)
    bound_batches(labelled.sparkSession)

    def gather(batches):
        mine: dict[int, list] = {}
        for b in batches:
            for p, *blobs in zip(*(b.column(c).to_pylist() for c in ("bucket", "both", "a", "b", "plain", "toxic")), strict=True):
                mine.setdefault(p, []).append([np.frombuffer(x, k) for x, k in zip(blobs, (np.uint64, np.uint64, np.uint64, np.int32, np.int32), strict=True)])
        names, kinds = ["kind", "blob"], [pa.int32(), pa.binary()]
        for parts in mine.values():
            both, a, b, plain, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(both, kind="stable")
            both, plain, toxic = both[order], plain[order], toxic[order]
            new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            both, a, b = both[new], a[order[new]], b[order[new]]
            c = [np.add.reduceat(x.astype(np.int64), new) for x in (plain, toxic)]
            word, b = np.unique(b, return_inverse=True)
            sums = [np.bincount(b, w, len(word)) for w in (c[0] > 0, c[1] > 0, np.ones(len(b)), c[0], c[1])]
            out = [(0, word.tobytes() + np.stack(sums).astype(np.float32).tobytes())]
            keep = c[0] + c[1] > SHARED_DISCOUNT
            if keep.any():
                rows = np.zeros(int(keep.sum()), KEPT_ROW)
                rows["both"], rows["a"], rows["c0"], rows["c1"] = both[keep], a[keep], c[0][keep], c[1][keep]
                out.append((1, rows.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    counted = save(_count(labelled.select("text", "toxic"), buckets).mapInArrow(tidied(gather), "kind int, blob binary"), "toxicity")
    words, sums = [np.zeros(1, np.uint64)], [np.zeros((5, 1), np.float32)]  # the start, which follows nothing
    for (blob,) in counted.where("kind = 0").select("blob").collect():
        n = len(blob) // 28
        words.append(np.frombuffer(blob, np.uint64, n))
        sums.append(np.frombuffer(blob, np.float32, 5 * n, 8 * n).reshape(5, n))
    words, sums = np.concatenate(words), np.concatenate(sums, axis=1)
    order = np.argsort(words)
    # contexts in ordinary, toxic, any texts; occurrences in ordinary, toxic texts; the last entry is any other word's
    words, sums = words[order], np.concatenate([sums[:, order], np.zeros((5, 1), np.float32)], axis=1)
    size = len(words) + 1
    rows = [np.frombuffer(blob, KEPT_ROW) for (blob,) in counted.where("kind = 1").select("blob").collect()]
    rows = np.concatenate([np.zeros(0, KEPT_ROW), *rows])
    rows = rows[np.argsort(rows["both"])]
    home, both_kept = find(words, rows["a"]), rows["c0"] + rows["c1"] - SHARED_DISCOUNT
    kept = [np.maximum(rows[f"c{c}"] * scale[c] - discount, 0) for c in (0, 1)]

    any_ = sums[2].astype(np.float64)
    shared = (any_ + 0.5) / (any_.sum() + 0.5 * size)
    small = max(1.0, min(sums[0].sum(), sums[1].sum()))
    # both classes give the lower level the same weight, so that what neither knows says nothing
    rest, unigram, backoff = np.zeros((2, size)), np.empty((2, size), np.float32), np.ones((2, size), np.float32)
    for c in (0, 1):
        n = sums[c].astype(np.float64)
        n *= min(1.0, small / max(1.0, n.sum()))
        rest[c] = np.maximum(n - continuation, 0) / max(1.0, n.sum())
        # a word is a context as often as it occurs (an end of text apart); the start is entry 0
        seen = np.maximum(sums[3 + c].astype(np.float64) * scale[c], 1e-9)
        seen[0] += texts_of.get(c, 0) * scale[c]  # every text starts once
        kept[c] = np.where(kept[c] > 0, kept[c] / seen[home], 0)
    mass = rest.sum(1)
    for c in (0, 1):
        unigram[c] = rest[c] * (mass.min() / mass[c] if mass[c] else 0) + (1 - mass.min()) * shared
    used = np.stack([np.bincount(home, kept[c], size) for c in (0, 1)])
    alike = np.minimum(used.min(0), 0.99)
    seen = np.maximum(sums[3].astype(np.float64) + sums[4], 1e-9)
    seen[0] += sum(texts_of.values())
    both_kept = np.where(both_kept > 0, both_kept / seen[home], 0)
    both_used = np.bincount(home, both_kept, size)
    both_kept = both_kept / np.maximum(1, both_used / 0.99)[home]
    for c in (0, 1):
        kept[c] *= np.divide(alike, used[c], out=np.zeros(size), where=used[c] > 0)[home]
        kept[c] += (1 - alike[home]) * both_kept
        backoff[c] = (1 - alike) * (1 - np.minimum(both_used, 0.99))
    none = np.zeros(1)
    return Model(words, unigram, backoff, rows["both"].copy(), np.stack([np.append(k, none) for k in kept]).astype(np.float32))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of documents with a label; of several labels the highest holds."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= MOST_LABELS:
        one = F.broadcast(one)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(one, "doc_id")


def features(difference: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The length-normalised difference in units of its standard error, and the root of the length, which takes up what an
    average word is off."""
    root = np.sqrt(np.maximum(1, count))
    return np.stack([np.ones(len(root)), np.clip(difference * root, -20, 20), np.minimum(root, 200) / 10], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25, steps: int = 4) -> np.ndarray:
    """(floor, weights...) of floor + (1 - floor) sigmoid(x w): some labels of either kind have no grounds in the text,
    and without a floor they would flatten the curve. Expectation maximisation around Newton's method; without both
    classes a constant of the prior."""
    w, floor = np.zeros(x.shape[1]), 0.02
    if not len(y) or y.min() == y.max():
        w[0] = -2.0 if not len(y) or y.max() == 0 else 2.0
        return np.concatenate([[0.0], w])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grounded = y * (1 - floor) * p / (floor + (1 - floor) * p)
        by_floor = (y * (1 - grounded)).sum() / max(1.0, (1 - grounded).sum())
        floor = min(0.3, by_floor)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - grounded) + ridge * w
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
    return np.concatenate([[floor], w])


def calibrated(difference: np.ndarray, count: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[0] + (1 - weights[0]) / (1 + np.exp(-np.clip(features(difference, count) @ weights[1:], -30, 30)))


MORE = "words long, ordinary_ll double, toxic_ll double"


def _scored(model: Model, texts: list[bytes]):
    """(words, ordinary and toxic log-likelihood a word) as arrays."""
    total, count = model.likelihoods(texts)
    mean = total / np.maximum(1, count)
    return count, mean[0], mean[1]


def score(docs: DataFrame, held, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, words, ordinary_ll, toxic_ll) of all documents by a broadcast model: log-likelihoods are a word's, 0
    without words."""

    def run(batches):
        for b in batches:
            told = _scored(held.value, as_bytes(b.column("text")))
            s = calibrated(told[2] - told[1], told[0], weights)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), *map(pa.array, told)], ["doc_id", "score", "words", "ordinary_ll", "toxic_ll"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id long, score double, {MORE}")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, words, ordinary_ll, toxic_ll) of every document.

    Learns from labelled rows whose crc32(doc_id) mod ``held_out`` is not 0. Null and empty texts get the score of no
    evidence. Null ids are held out. Rows of equal id stand for themselves. Without labels every score is the prior's.
    Empty tables give no rows. Other columns are ignored.
    """
    out_ = F.coalesce(crc_mod(F.col("doc_id"), held_out) == 0, F.lit(True))
    learn = with_labels(docs, labels).where(~out_)
    held = docs.sparkSession.sparkContext.broadcast(train(learn))
    # an even spread over ids, whatever their number
    part = max(1, learn.select("doc_id").count() // CALIBRATION_ROWS)
    few = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
    if few.select("doc_id").count() > 2 * CALIBRATION_ROWS:  # ids that repeat
        few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * CALIBRATION_ROWS)

    def evidence(batches):
        for b in batches:
            told = _scored(held.value, as_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *map(pa.array, told)], ["toxic", "words", "ordinary_ll", "toxic_ll"])

    rows = few.select("text", "toxic").mapInArrow(tidied(evidence), f"toxic int, {MORE}").toPandas()
    weights = logistic(features((rows["toxic_ll"] - rows["ordinary_ll"]).to_numpy(), rows["words"].to_numpy()), rows["toxic"].to_numpy().astype(float))
    return score(docs, held, weights).select("doc_id", out_.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "words", "ordinary_ll", "toxic_ll")


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
