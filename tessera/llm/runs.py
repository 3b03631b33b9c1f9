"""Operator 11, periodic runs of words.

A run is a stretch of words with smallest period q and a length of at least max(least, 2 q) that no neighbouring word
extends. Every run of period p holds two neighbouring points of the grid 0, p, 2p, ...; over all periods these are about
n ln n pairs (the harmonic sum). All pairs of many texts are looked at together: those whose words differ go first, and for
the others the common extensions to both sides are binary-searched side by side on prefix hashes. What is found is compared
word by word, and periods that are multiples of a smaller one are dropped.

Scale: one scan without a shuffle. Memory follows the texts of a portion, a bounded number of bytes unless one text is
longer, and a bounded number of pairs at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, as_bytes, byte_hashes, mix, portions, table, tidied, word_spans

LEAST = 12
PAIRS = 1 << 20
PRIME = U64((1 << 31) - 1)
BASES = (U64(1_273_642_419), U64(683_771_801))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of both bases modulo the prime, kept by a worker."""
    if not _POWERS or len(_POWERS[0]) <= n:
        out = []
        for base in BASES:
            p = np.ones(1, np.uint64)
            step = base
            while len(p) <= n:
                p = np.concatenate([p, p * step % PRIME])
                step = step * step % PRIME
            out.append(p)
        _POWERS[:] = out
    return _POWERS


class Prefixes:
    """Hashes of all prefixes of a row of words, so that any two stretches are compared at once. Equal stretches always
    compare equal; different ones hardly ever do."""

    def __init__(self, words: np.ndarray) -> None:
        self.power = _powers(len(words) + 1)
        self.sums = []
        for k, p in enumerate(self.power):
            part = (words >> U64(31 * k)) % PRIME * p[: len(words)] % PRIME
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(part) % PRIME]))

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i are those from j; j > i."""
        out = np.ones(len(i), bool)
        for s, p in zip(self.sums, self.power, strict=True):
            a, b = s[i + n] + PRIME - s[i], s[j + n] + PRIME - s[j]
            out &= a % PRIME * p[j - i] % PRIME == b % PRIME
        return out


def _furthest(same, most: np.ndarray) -> np.ndarray:
    """For each pair the largest n up to ``most`` with same(n), by binary search side by side."""
    lo, hi = np.zeros_like(most), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        ok = same(mid)
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
    return lo


def _grid(edges: np.ndarray, least: int):
    """Portions of all (text, period, first word of a pair of neighbouring grid points)."""
    n = np.diff(edges)
    n = np.where(n >= max(2, least), n, 0)
    most = n // 2  # periods 1..most
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (n[text] - 1) // period
    ends = np.cumsum(pairs)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        k = pairs[lo:hi]
        of = np.repeat(np.arange(lo, hi), k)
        step = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
        yield text[of], period[of], edges[text[of]] + step * period[of]
        lo = hi


def _by_comparison(words: np.ndarray, i: int, p: int, begin: int, end: int) -> tuple[int, int]:
    """(start, end) of the stretch around i that keeps period p, by looking at the words."""
    off = np.flatnonzero(words[i : end - p] != words[i + p : end])
    far = i + p + int(off[0]) if len(off) else end
    off = np.flatnonzero(words[begin:i] != words[begin + p : i + p])
    return (begin + int(off[-1]) + 1 if len(off) else begin), far


def periodic_runs(words: np.ndarray, edges: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of words that are given by numbers; text i has words
    edges[i]..edges[i+1], starts are counted within the text; ordered by text, start, period."""
    prefixes = Prefixes(words)
    more = np.concatenate([words, words[:2]])  # for a look one word past either end
    found = []
    for text, p, i in _grid(edges, least):
        on = words[i] == words[i + p]
        text, p, i = text[on], p[on], i[on]
        if least > 2:  # a run goes on by a word to either side
            on = (more[i + 1] == more[i + p + 1]) | (more[i - 1] == more[i + p - 1])
            text, p, i = text[on], p[on], i[on]
        j = i + p
        ahead = _furthest(lambda n, i=i, j=j: prefixes.same(i, j, n), edges[text + 1] - j)
        behind = _furthest(lambda n, i=i, j=j: prefixes.same(i - n, j - n, n), i - edges[text])
        on = ahead + behind + p >= np.maximum(least, 2 * p)
        if on.any():
            found.append(_verified(words, edges, least, np.stack([text, i - behind, j + ahead, p, i])[:, on]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    rows = np.concatenate(found, axis=1)
    text, start, end, p = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    new = np.ones(len(text), bool)  # the smallest period of a stretch; larger ones are its multiples
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, p = text[new], start[new], end[new], p[new]
    order = np.lexsort((p, start, text))
    text, start, end, p = text[order], start[order], end[order], p[order]
    return text, start - edges[text], end - start, p


def _verified(words: np.ndarray, edges: np.ndarray, least: int, rows: np.ndarray) -> np.ndarray:
    """The distinct (text, start, end, period) of rows (text, start, end, period, grid point), each compared word by word."""
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:4, 1:] != rows[:4, :-1]).any(0)
    out = rows[:4, new]
    bad = np.array([not np.array_equal(words[s : e - q], words[s + q : e]) for _, s, e, q in out.T.tolist()], bool)
    if not bad.any():
        return out
    # two stretches met by chance: all their pairs again, by comparison
    again = [(t, *_by_comparison(words, k, q, edges[t], edges[t + 1]), q) for t, _, _, q, k in rows[:, bad[np.cumsum(new) - 1]].T.tolist()]
    again = np.array([x for x in again if x[2] - x[1] >= max(least, 2 * x[3])], np.int64).reshape(-1, 4).T
    return np.concatenate([out[:, ~bad], again], axis=1)


def spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, edges, start, end) of the words of some texts, each followed by one space."""
    data, edges, start, end = word_spans(texts)
    keep = np.zeros(len(data), bool)
    size = end - start
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    keep[at] = True
    keep[end] = True  # the byte after a word, a separator
    out = data[keep]
    end = np.cumsum(size + 1) - 1
    out[end] = 0x20
    return out, edges, end - size, end


def _runs_of(data: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray, least: int):
    """``periodic_runs`` of the words of some texts. Every run is compared byte by byte; where hashes of different words
    met, the text is done again with words numbered."""
    runs = periodic_runs(byte_hashes(data, start, end), edges, least)
    wrong = set()
    for t, s, n, p in zip(*(r.tolist() for r in runs), strict=True):
        s += int(edges[t])
        if data[start[s] : end[s + n - p - 1]].tobytes() != data[start[s + p] : end[s + n - 1]].tobytes():
            wrong.add(t)
    for t in sorted(wrong):
        lo, hi = int(edges[t]), int(edges[t + 1])
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(data[a:b].tobytes(), len(number)) for a, b in zip(start[lo:hi], end[lo:hi], strict=True)], np.uint64)
        _, s, n, p = periodic_runs(mix(ids), np.array([0, hi - lo]), least)
        on = runs[0] != t
        runs = tuple(np.concatenate([a[on], b]) for a, b in zip(runs, (np.full(len(s), t), s, n, p), strict=True))
    if wrong:
        order = np.lexsort((runs[3], runs[1], runs[0]))
        runs = tuple(r[order] for r in runs)
    return runs


def _collapsed(data: np.ndarray, start: np.ndarray, end: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, one space between; of one text."""
    n = len(start)
    if not runs:
        return data[start[0] : end[-1]].tobytes() if n else b""
    turn = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        turn[s + p] += 1
        turn[s + length] -= 1
    kept = np.concatenate([[False], np.cumsum(turn[:-1]) == 0, [False]])
    cut = np.flatnonzero(kept[1:] != kept[:-1])
    return b" ".join(data[start[a] : end[b - 1]].tobytes() for a, b in zip(cut[::2], cut[1::2], strict=True))


FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its periodic runs of at least ``least`` words, by start, then
    period, and the text with each run cut to its first period, words joined by one space.

    Null, empty and blank texts: no words, no runs, the empty text. Null or repeated ids: each row stands for itself.
    Stretches that several runs share are dropped once. An empty table gives no rows. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            for lo, hi in portions([len(t) for t in texts]):
                data, edges, start, end = spaced(texts[lo:hi])
                each: list[list[tuple[int, int, int]]] = [[] for _ in range(hi - lo)]
                if len(start):
                    for t, s, n, p in zip(*(r.tolist() for r in _runs_of(data, edges, start, end, least)), strict=True):
                        each[t].append((s, n, p))
                rest = [_collapsed(data, start[a:z], end[a:z], each[t]) for t, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                told = [[{"start": s, "length": n, "period": p} for s, n, p in x] for x in each]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(edges)), pa.array(told, kind), pa.array(rest, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), FOUND)


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id's crc32 is a multiple of ten repeat a stretch of their words to the end, by the
    query's rule; the others, and those with a null id, are as they were."""

    def run(batches):
        for b in batches:
            out = as_bytes(b.column("text"))
            for k, i in enumerate(b.column("doc_id").to_pylist()):
                h = zlib.crc32(str(i).encode())
                if i is None or h % 10:
                    continue
                data, _, start, end = spaced(out[k : k + 1])
                if n := len(start):
                    g = h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    whole, part = divmod(n - a, p)
                    unit = data[start[a] : end[a + p - 1] + 1].tobytes()
                    out[k] = data[: start[a]].tobytes() + unit * whole + (data[start[a] : end[a + part - 1]].tobytes() if part else b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, edited by the query's rule, as counts, the longest run and digests."""
    found = find_runs(edited(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    out = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.short")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
