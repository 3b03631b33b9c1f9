"""Operator 8, language identification of mixed text.

Words are runs of letters. Their script (by code-point ranges) narrows the candidate languages; letter trigrams give
every word a log-likelihood in each; a Viterbi pass over a text's words with a switching penalty labels spans, and the
language that covers most letters is the text's.

Scale: trigram counts of all training texts go into a table of fixed size (languages x ``SLOTS``), added up in a tree
on the executors; only that table is broadcast. Scoring is one scan without a shuffle.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, crc_mod, given_names, packed, plain_names, tidied, tree_sum

SLOTS = 1 << 17
MOST_LANGUAGES = 500
PENALTY = 8.0
OTHER_SCRIPT = 60.0
#: First code points of scripts; each range ends where the next begins (0: no or another script).
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xF900, "han"), (0xFB50, "arabic"), (0xFF00, "latin"), (0x20000, "han"),
)
NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script. Built once a worker."""
    if not _TABLES:
        n = 0x40000  # beyond are private use and tags: no letters
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(n):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                letter[c] = True
                if len(low := ch.lower()) == 1:
                    lower[c] = ord(low)
        starts = np.array([c for c, _ in SCRIPTS])
        ids = np.array([0] + [NAMES.index(s) for _, s in SCRIPTS], np.uint8)
        _TABLES["script"] = ids[np.searchsorted(starts, np.arange(n), side="right")]
        _TABLES.update(letter=letter, lower=lower)
    return _TABLES["letter"], _TABLES["lower"], _TABLES["script"]


def _grams(texts: list[str]):
    """Of the words of some texts: (slot of each trigram, its word, word start, word length, word script, text of each word)."""
    letter, lower, script = _tables()
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_l = letter[cp]
    c0 = np.where(is_l, lower[cp], 0).astype(np.uint64)
    c1 = np.concatenate([np.zeros(1, np.uint64), c0[:-1]])
    c2 = np.concatenate([np.zeros(1, np.uint64), c1[:-1]])
    c2[c1 == 0] = 0
    before = np.concatenate([[False], is_l[:-1]])
    start = is_l & ~before
    at = is_l | before  # a word's letters and the position after its last
    word = np.cumsum(start) - 1
    slot = ((c0 * U64(0x9E3779B97F4A7C15) + c1 * U64(0xC2B2AE3D27D4EB4F) + c2 * U64(0x165667B19E3779F9))[at] >> U64(40)).astype(np.int64) & (SLOTS - 1)
    begin = np.flatnonzero(start)
    length = np.bincount(word[is_l], minlength=len(begin)).astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = cp[begin]
    kinds = np.where(first < len(script), script[np.minimum(first, len(script) - 1)], NAMES.index("other"))
    return slot, word[at], begin, length, kinds, np.searchsorted(ends, begin, side="right")


def _portions(texts: list[str], chars: int = 500_000):
    """Ranges of texts of about so many characters together."""
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Model:
    """Languages (sorted), their log-likelihood by slot, and the scripts that each is written in."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.loglik = np.ascontiguousarray(np.log((counts + 0.5) / (total + 0.5 * SLOTS)).T.astype(np.float32))
        allowed = scripts >= 0.001 * scripts.sum(1, keepdims=True).clip(1)
        allowed[:, ~allowed.any(0)] = True  # a script that no language is written in narrows nothing
        self.cost = np.where(allowed.T, 0, -OTHER_SCRIPT).astype(np.float32)


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Counts over all given rows with a label. Null texts count nothing; no labelled row gives an empty model."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang")).where("lang is not null")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number, width = {s: i for i, s in enumerate(languages)}, SLOTS + len(NAMES)

    def count(batches):
        total = np.zeros((len(number), width), np.int64)
        for b in batches:
            by: dict[str, list[str]] = {}
            for t, s in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                by.setdefault(s, []).append(t or "")
            for s, texts in by.items():
                for lo, hi in _portions(texts):
                    slot, _, _, length, kinds, _ = _grams(texts[lo:hi])
                    total[number[s], :SLOTS] += np.bincount(slot, minlength=SLOTS)
                    total[number[s], SLOTS:] += np.bincount(kinds, length, len(NAMES)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([packed(total.ravel())])], ["blob"])

    total = tree_sum(rows.mapInArrow(tidied(count), "blob binary"), max(1, len(languages) * width))
    total = total.reshape(len(languages), width) if languages else np.zeros((0, width))
    return Model(languages, total[:, :SLOTS], total[:, SLOTS:])


def _viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word; texts (rows first..first+count) advance side by side, longest first."""
    out = np.zeros(len(score), np.int16)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    active = np.searchsorted(-count, -np.arange(int(count[0]) if len(count) else 0), side="left")
    v = np.zeros((len(first), score.shape[1]), np.float32)
    stay, jump = np.zeros(score.shape, bool), np.zeros(len(score), np.int16)
    rows = np.arange(len(first))
    for t, n in enumerate(active):
        at, top = first[:n] + t, v[:n]
        best = top.argmax(1)
        high = top[rows[:n], best] - penalty
        stay[at] = top >= high[:, None]
        jump[at] = best
        v[:n] = np.maximum(top, high[:, None]) + score[at]
    now = v.argmax(1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        out[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], jump[at])
    return out


def label_words(texts: list[str], model: Model, penalty: float = PENALTY):
    """(text, start, length, language number) of every word, as arrays."""
    parts = []
    for lo, hi in _portions(texts):
        slot, word, begin, length, kinds, text = _grams(texts[lo:hi])
        score = np.zeros((len(begin), len(model.languages)), np.float32)
        if len(begin):
            edges = np.flatnonzero(np.diff(word, prepend=-1))
            for k in range(len(model.languages)):
                score[:, k] = np.add.reduceat(model.loglik[:, k][slot], edges)
            score += model.cost[kinds]
        offset = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        parts.append((text + lo, begin - offset[text] if len(begin) else begin, length, score))
    text, begin, length, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(model.languages)), np.float32))
    if not len(text):
        return text, begin, length, np.zeros(0, np.int16)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    return text, begin, length, _viterbi(score, first, np.diff(np.append(first, len(text))), penalty)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score and, on request, lang_spans, the maximal runs (start, end, lang) in
    code points. ``names`` are the names of the three; columns of these names, in upper or lower case, are replaced.

    score: the share of the text's letters in the predicted language. Null or letterless text: ``und``, 0, no spans;
    so is every text if no language was learned. Ties go to the language that sorts first. Null or repeated ids: each
    row stands for itself. An empty table gives no rows.
    """
    docs, given = plain_names(docs)
    kept = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        m = held.value
        for whole in batches:
            texts_all = [t or "" for t in whole.column("text").to_pylist()]
            for lo, hi in _portions(texts_all, 1_500_000):
                b, texts = whole.slice(lo, hi - lo), texts_all[lo:hi]
                pred, score, runs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
                if m.languages:
                    text, begin, length, lang = label_words(texts, m, penalty)
                    k = len(m.languages)
                    share = np.bincount(text * k + lang, length, len(texts) * k).reshape(-1, k)
                    total = share.sum(1)
                    best = share.argmax(1)
                    score = np.where(total > 0, share[np.arange(len(texts)), best] / total.clip(1), 0.0)
                    pred = [m.languages[x] if n else "und" for x, n in zip(best, total, strict=True)]
                    if spans and len(text):
                        cut = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
                        last = np.append(cut[1:], len(text)) - 1
                        for a, z in zip(cut, last, strict=True):
                            runs[text[a]].append({"start": int(begin[a]), "end": int(begin[z] + length[z]), "lang": m.languages[lang[a]]})
                extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64())] + ([pa.array(runs, span)] if spans else [])
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *extra], [*(f.name for f in kept), *names[: 3 if spans else 2]])

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    if spans:
        one = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
        schema = schema.add(names[2], T.ArrayType(one))
    return given_names(docs.select([f.name for f in kept]).mapInArrow(tidied(run), schema), given)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a language is given, and the id is not held out."""
    return docs.where(F.col("lang").isNotNull() & (F.coalesce(crc_mod(F.col("doc_id"), 3), F.lit(1)) != 1))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(training_rows(docs))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
