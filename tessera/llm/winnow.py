"""Operator 4, document fingerprints by winnowing.

Rolling hashes of all k-grams of a text's UTF-8 bytes; from every window of w consecutive hashes the smallest is
chosen, the rightmost on ties, and its position is kept. Two texts that share w + k - 1 bytes share a fingerprint
entry; nothing shorter than k can match.

Scale: fingerprints are one scan. The query also needs each document's successor by id: one shuffle brings the texts
into ranges of ids of about equal bytes, one a task, every range is sorted and streamed with one row looked ahead, and the
first document of a range is sent to the range before it as well, so no window ever spans the table. Ranges are put together
from cells: stretches of ids of about equal counts, cut evenly by value; what the driver holds is a number a cell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTES, U64, mix, tidied

K, W = 16, 16
_R = 0x9E3779B97F4A7C15


def _rolling(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte runs, put together from runs of powers of two."""
    have, size, run, length = None, 0, BYTES[a], 1
    while True:
        if k & length:
            have, size = (run, length) if have is None else (have[: len(a) - size - length + 1] * U64(pow(_R, length, 2**64)) + run[size : len(a) - length + 1], size + length)
        length *= 2
        if length > k:
            return have
        run = run[: len(a) - length + 1] * U64(pow(_R, length // 2, 2**64)) + run[length // 2 : length // 2 + len(a) - length + 1]


def winnow(data: bytes, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 32 bits, positions), by position. A text shorter than k is one k-gram; the empty text has none;
    with fewer than w k-grams there is one window."""
    if not data:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(data))
    h = mix(_rolling(np.frombuffer(data, np.uint8), k)) >> U64(32)
    n = len(h)
    w = min(w, n)
    key = h << U64(32) | (U64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))  # smallest hash, then the rightmost
    low, length = key, 1
    while length * 2 <= w:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    if length < w:
        low = np.minimum(low[: n - w + 1], low[w - length : n - length + 1])
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (low >> U64(32)).astype(np.uint32), (U64(0xFFFFFFFF) - (low & U64(0xFFFFFFFF))).astype(np.int64)


def text_of(hashes: np.ndarray) -> str:
    """The fingerprint as text: eight hex digits an entry, by position, comma-separated."""
    return hashes.astype(">u4").tobytes().hex(",", 4) if len(hashes) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the distinct hashes; two empty fingerprints are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, fingerprint, positions array): one row a row. Null text is the empty text; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            found = [winnow(t or b"", k, w) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([text_of(h) for h, _ in found]), pa.array([p for _, p in found], pa.list_(pa.int64()))], ["doc_id", "fingerprint", "positions"])

    return rows.mapInArrow(tidied(run), "doc_id long, fingerprint string, positions array<long>")


STRETCHES, CELLS = 4096, 1 << 20


def cells(ids: DataFrame, n_rows: int, rows_a_cell: int = 64) -> np.ndarray:
    """The borders of cells of ids, sorted; as many as there are ``rows_a_cell`` rows, at most ``CELLS``."""
    most = max(1, min(n_rows // rows_a_cell, CELLS))
    parts = min(most, STRETCHES)
    told = ids.agg(F.min("i"), F.max("i"), F.percentile_approx("i", [j / parts for j in range(1, parts)] or [0.5], 10 * parts)).first()
    edges = sorted({told[0], told[1], *told[2]}) if told[0] is not None else []
    cuts: set[int] = set()
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        step = max(1, (z - a) // max(1, most // parts))
        cuts.update(range(a + step, z, step))
        cuts.add(z)
    return np.array(sorted(cuts), np.int64)


def _even_keys(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash puts there."""
    where = spark.range(0, 32 * n + 64, numPartitions=1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    found = dict(map(tuple, where.collect()))
    return [found.get(p, p) for p in range(n)]


def by_range(docs: DataFrame, bytes_a_range: int = 8 << 20, most_ranges: int = CELLS) -> DataFrame:
    """(part, ahead, doc_id, text): documents in ranges of ids, a partition each; the first of each range also, as
    ``ahead``, in the range before, and the very first in the last. Null ids sort first; equal ids are ordered by text and
    stay together. An empty table gives no rows."""
    spark, none = docs.sparkSession, -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = rows.select(F.coalesce("doc_id", F.lit(none)).alias("i"), F.octet_length("text").alias("size"))
    held = spark.sparkContext.broadcast(cells(sized.where(F.col("i") > none), rows.count()))

    def weigh(batches):
        size: dict[int, list[int]] = {}
        for b in batches:
            i, n = np.array(b.column("i"), np.int64), np.array(b.column("size"), np.int64)
            order = np.argsort(i, kind="stable")
            cell = np.searchsorted(held.value, i[order], side="right")
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            total = np.add.reduceat(n[order], first) if len(first) else first
            for c, v, s in zip(cell[first].tolist(), i[order][first].tolist(), total.tolist(), strict=True):
                old = size.get(c, (v, 0))
                size[c] = min(v, old[0]), s + old[1]
        yield pa.RecordBatch.from_arrays([pa.array(list(size), pa.int64()), pa.array([v for v, _ in size.values()], pa.int64()), pa.array([s for _, s in size.values()], pa.int64())], ["cell", "i", "size"])

    told = sorted(map(tuple, sized.mapInArrow(tidied(weigh), "cell long, i long, size long").groupBy("cell").agg(F.min("i"), F.sum("size")).collect()))
    most = max(bytes_a_range, sum(s for *_, s in told) // most_ranges)
    heads, now = [], 0  # the smallest id of each range
    for _, i, size in told:
        if not heads or now + size > most:
            heads.append(i)
            now = 0
        now += size
    parts = max(1, len(heads))
    begin = spark.sparkContext.broadcast((np.array(heads, np.int64), np.array(_even_keys(spark, parts), np.int64)))

    def number(batches):
        head, key = begin.value
        for b in batches:
            i = np.array(b.column("doc_id").fill_null(none), np.int64)
            part = np.searchsorted(head, i, side="right") - 1
            again = np.flatnonzero(np.isin(i, head))
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(np.zeros(len(i), np.int32)), *b.columns], ["part", "ahead", "doc_id", "text"])
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array(key[part[again] - 1]), pa.array(np.ones(len(again), np.int32)), *b.take(pa.array(again)).columns], ["part", "ahead", "doc_id", "text"])

    placed = rows.mapInArrow(tidied(number), "part long, ahead int, doc_id long, text string")
    return placed.repartition(parts, "part").sortWithinPartitions("part", "ahead", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>"


def compare_with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document with its edited text (the last quarter of its code points replaced by the first as many of the
    next document) and the next document: digests, fingerprints, likeness. A single document is its own next.

    Null text is the empty one. Rows of equal doc_id, copies of a row too, are ordered by text and each has a next; a null
    doc_id comes first. An empty table gives no rows. Other columns are ignored."""
    ranges = by_range(docs)
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]

    def run(batches):
        def stream():
            for b in batches:
                yield from zip(b.column("part").to_pylist(), b.column("ahead").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)

        def rows():
            last = None
            for part, ahead, doc, text in stream():
                own = winnow(text.encode(), k, w)
                if last is not None and last[0] == part:
                    _, d, t, (h, p) = last
                    cut = len(t) // 4
                    edited = t[: len(t) - cut] + text[:cut] if cut else t
                    data = edited.encode()
                    e, _ = winnow(data, k, w)
                    yield d, len(t), hashlib.sha256(data).hexdigest(), text_of(h), text_of(e), likeness(h, e), likeness(h, own[0]), p
                last = None if ahead else (part, doc, text, own)

        some = []
        for row in rows():
            some.append(row)
            if len(some) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*some, strict=True), types, strict=True)], names)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*some, strict=True), types, strict=True)], names)

    return ranges.mapInArrow(tidied(run), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
