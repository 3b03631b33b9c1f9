"""Operator 2, suffix-array dedup: maximal repeats from the interval tree of an enhanced suffix array.

The kernel, ``maximal_repeats``, sorts suffixes, takes the common prefixes of neighbours, scans them with a stack into
intervals (the nodes of the common-prefix tree) and keeps those whose left extensions differ: each is a maximal repeat
with all its occurrences.

The suffix array of a corpus is dealt out exactly. Every string of ``LENGTH`` bytes is assigned to the k-gram that is
smallest by hash among those in it (rightmost on ties), its anchor: equal strings have equal anchors at equal offsets,
wherever they stand. The strings of one text that share an anchor are one stretch, the anchor's cut; equal cuts of one
task are one entry with its smallest and largest document, so a passage in a third of all texts is one entry a task. So

1. a scan deals 64-bit digests of all cuts by anchor. An anchor whose cuts are all equal has a tree of one leaf, and that
   leaf is the one maximal repeat: the cut itself, with all its entries. Anchors with several cuts go into a bitmap;
2. a second scan deals the cuts of these themselves; all of an anchor meet in one bucket, where the kernel finds the
   groups: the interval nodes of the tree, and the leaves that have several documents;
3. each group's occurrences go back, entry by entry, to the tasks they came from, never to single hot keys, and meet there
   the places of the entries (a third scan). From them come the groups with all occurrences (``maximal_repeat_groups``)
   and the bytes that a document shares with a smaller one (``repeats``), merged into runs.

A group is a maximal repeat within the cuts of one anchor, at most 76 bytes long: a longer common passage is a chain of
overlapping groups, one an anchor.

Broadcast is the bitmap only, sized by what it holds up to 128 MB: beyond that more cuts are dealt, the result stays the
same.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, as_bytes, bits_for, bloom, bloom_has, buckets_for, discard, mix, portions, release, save, span_hashes, tidied, tidy
from tessera.llm.winnow import _R, _rolling

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
WIDTH = 80  # at least 2 * LENGTH - GRAM, the longest cut
MOST_BITS = 30
PORTION = 300_000
BUCKET_BYTES = 16 << 20  # text a bucket, at most: what a task holds of it does not grow with the input's partitions
NONE = -(2**63)


def _small(data, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(bytes(data))


def _array(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _steps(x: np.ndarray) -> bytes:
    """Numbers that mostly grow, packed as their differences."""
    return _small(np.diff(x, prepend=x.dtype.type(0)))


def _summed(blob: bytes, kind) -> np.ndarray:
    return np.cumsum(_array(blob, kind), dtype=kind)


# --- the kernel
def suffix_array(buffer: np.ndarray, begin: np.ndarray, stop: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes buffer[begin:stop], compared on ``width`` bytes; lcp[i] belongs to order[i-1], order[i]."""
    room = np.concatenate([buffer, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(room, width)[begin]
    left = np.minimum(stop - begin, width)
    rows = np.where(np.arange(width) < left[:, None], rows, 0)
    words = rows.view(">u8")
    order = np.lexsort((left, *(words[:, k].astype(np.uint64) for k in range(width // 8 - 1, -1, -1))))
    rows, left = rows[order], left[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        lcp[1:] = np.minimum(first, np.minimum(left[1:], left[:-1]))
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common prefix, first, last) of all nodes of the common-prefix interval tree with a prefix of ``least`` or more."""
    depth, low, high = [], [], []
    deep = lcp >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # lcp[a:z] >= least: suffixes a-1 .. z-1
        stack_l, stack_b = [0], [a - 1]
        for i, value in enumerate([*lcp[a:z].tolist(), 0], a):
            left = i - 1
            while value < stack_l[-1]:
                depth.append(stack_l.pop())
                left = stack_b.pop()
                low.append(left)
                high.append(i - 1)
            if value > stack_l[-1]:
                stack_l.append(value)
                stack_b.append(left)
    return np.array(depth, np.int64), np.array(low, np.int64), np.array(high, np.int64)


def maximal_repeats(buffer: np.ndarray, begin: np.ndarray, stop: np.ndarray, start: np.ndarray, least: int = LENGTH, width: int = WIDTH):
    """Maximal repeat groups among the suffixes ``begin`` (``start``: where the string of each starts).

    Returns (order, length, first, last): group g is the prefix of length[g] shared by suffixes order[first[g]..last[g]],
    which are all its occurrences. A group is kept only if the bytes on the left differ or one has none there.
    """
    order, lcp = suffix_array(buffer, begin, stop, width)
    return order, *_diverse(buffer, begin, start, order, lcp, least)


def _diverse(buffer, begin, start, order, lcp, least: int):
    """(length, first, last) of the interval nodes whose left extensions differ."""
    length, first, last = intervals(lcp, least)
    at = begin[order]
    edge = at == start[order]
    before = np.where(edge, 256, buffer[np.maximum(at - 1, 0)])
    change = np.zeros(len(at), np.int64)
    change[1:] = (before[1:] != before[:-1]) | edge[1:] | edge[:-1]
    change = np.cumsum(change)
    diverse = change[last] > change[first] if len(first) else np.zeros(0, bool)
    return length[diverse], first[diverse], last[diverse]


def repeat_groups(buffer, begin, stop, start, low, high, least: int = LENGTH):
    """(group, member, starts, smallest document): every occurrence, as a suffix, of the maximal repeat groups that lie in
    two documents or more; ``starts`` is how many strings of ``least`` bytes the repeat holds, low and high are the
    smallest and largest document of each suffix. A suffix that stands for several documents and is no prefix of another
    is a leaf of its own, a group where its string begins (further in, the string has one left extension only)."""
    order, lcp = suffix_array(buffer, begin, stop)
    length, first, last = _diverse(buffer, begin, start, order, lcp, least)
    size = (stop - begin)[order]
    leaf = np.flatnonzero((begin == start)[order] & (lcp < size) & (np.append(lcp[1:], 0) < size) & (low < high)[order])
    length, first, last = np.append(length, size[leaf]), np.append(first, leaf), np.append(last, leaf)
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    some = np.stack([first, last + 1], 1).ravel()
    smallest = np.minimum.reduceat(np.append(low[order], np.iinfo(np.int64).max), some)[::2]
    largest = np.maximum.reduceat(np.append(high[order], np.iinfo(np.int64).min), some)[::2]
    on = smallest < largest
    first, n, length, smallest = first[on], (last - first + 1)[on], length[on], smallest[on]
    group = np.repeat(np.arange(len(n)), n)
    member = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return group, member, (length - least + 1)[group], smallest[group]


# --- anchors
def anchors(texts: list[bytes]):
    """(hash, text, anchor, first, last): runs of string starts first..last of a text that share an anchor; positions in
    the joined texts; and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, begins, data
    h = _rolling(data, GRAM)  # of random numbers for bytes, so its upper bits are mixed enough to order by
    h = (h ^ (h >> U64(32))) * U64(_R | 1)
    key = (h & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    low, length = key, 1
    while length * 2 <= SPAN:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    if length < SPAN:
        n = len(h) - SPAN + 1
        low = np.minimum(low[:n], low[SPAN - length : SPAN - length + n])
    anchor = (U64(0xFFFFFFFF) - (low & U64(0xFFFFFFFF))).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int32)
    some = sizes >= LENGTH
    np.add.at(valid, begins[some], 1)
    np.add.at(valid, begins[some] + sizes[some] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    a = anchor[starts]
    text = np.searchsorted(begins, starts, side="right") - 1
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return mix(h[a[first]]), text[first], a[first], starts[first], starts[last] if len(first) else starts[:0], begins, data


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket is a range of hashes."""
    return ((h >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)


def _six(h: np.ndarray) -> bytes:
    """The upper six bytes of hashes; two anchors with the same are only solved together."""
    return (h >> U64(32)).astype(np.uint32).tobytes() + (h >> U64(16)).astype(np.uint16).tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) << U64(32) | np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << U64(16)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _slot(h, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1


def bitmap_of(marks: DataFrame) -> np.ndarray:
    """The bitmap of (hashes) blobs, each of one bucket: what reaches the driver, in one job, are its own bytes."""
    n = marks.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    bits = bits_for(n // 6, most=MOST_BITS)

    def fill(batches):
        for b in batches:
            for blob in b.column("hashes").to_pylist():
                at = np.unique(_slot(_from_six(blob), bits))
                lo = int(at[0]) >> 3
                part = np.zeros((int(at[-1]) >> 3) - lo + 1, np.uint8)
                np.bitwise_or.at(part, (at >> 3) - lo, (1 << (at & 7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([zlib.compress(part.tobytes(), 1)])], ["lo", "bits"])

    out = np.zeros(1 << bits - 3, np.uint8)
    for lo, blob in marks.mapInArrow(tidied(fill), "lo long, bits binary").collect():
        part = np.frombuffer(zlib.decompress(blob), np.uint8)
        out[lo : lo + len(part)] |= part
    return out


ENTRY = "task long, bucket int, hashes binary, ids binary, low binary, high binary, sizes binary, wins binary, cuts binary, digests binary, rows binary, uses binary, at binary"


def cut_out(docs: DataFrame, buckets: int, what: str, only: np.ndarray | None = None) -> DataFrame:
    """By ``what``: ``digests``, entries without their bytes, dealt by anchor; ``cuts``, with their bytes, of the anchors
    in the bitmap ``only``; ``own``, per task the occurrences of its entries. All come from one deterministic scan, run
    again: that is less than to store the cuts."""
    held = docs.sparkSession.sparkContext.broadcast(only)
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 11

    def scan(batches):
        me, flushes = TaskContext.get().partitionId(), 0
        parts, whole, n_whole = [], [], 0
        chosen, held_n = held.value, 0

        def flush():
            nonlocal flushes
            task, flushes = me << 24 | flushes, flushes + 1
            h, doc, row, at, win, key, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, one, entry = np.unique(key, return_index=True, return_inverse=True)  # equal cuts are one entry
            turn = np.argsort(one)  # numbered as they come, so that their numbers and documents grow
            new = np.empty(len(turn), np.int64)
            new[turn] = np.arange(len(turn))
            entry, one = new[entry], one[turn]
            if what == "own":
                out = [(task, None, None, None, _steps(doc), None, None, None, None, None, *map(_steps, (row, entry.astype(np.int32), at.astype(np.int32))))]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
            np.minimum.at(low, entry, doc)
            np.maximum.at(high, entry, doc)
            bucket = _bucket(h[one], buckets)
            if what == "cuts":
                bucket[~_has(chosen, h[one])] = buckets
                data = b"".join(whole)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for p in np.flatnonzero(np.diff(edges)):
                e = order[edges[p] : edges[p + 1]]
                i = one[e]
                common = task, int(p), _six(h[i]), _steps(e.astype(np.int32)), _steps(low[e]), _small(high[e] - low[e])
                if what == "digests":
                    out.append((*common, None, _small(win[i].astype(np.uint8)), None, key[i].tobytes(), None, None, None))
                else:
                    size = win[i] + LENGTH - 1
                    cuts = b"".join([data[a:z] for a, z in zip(place[i].tolist(), (place[i] + size).tolist(), strict=True)])
                    out.append((*common, _small(size.astype(np.uint8)), _small(win[i].astype(np.uint8)), _small(cuts, 5), None, None, None, None))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            texts, ids, rows = as_bytes(b.column("text")), np.array(b.column("doc_id").fill_null(NONE), np.int64), np.array(b.column("row"), np.int64)
            for lo, hi in portions([len(t) for t in texts], PORTION):
                h, text, _, first, last, begins, data = anchors(texts[lo:hi])
                if not len(h):
                    continue
                parts.append((h, ids[lo:hi][text], rows[lo:hi][text], first - begins[text], last - first + 1, span_hashes(data, first, last + LENGTH), first + n_whole))
                if what == "cuts":
                    whole.append(data.tobytes())
                n_whole += len(data)
                held_n += len(h)
                if held_n > 300_000:
                    if (out := flush()) is not None:
                        yield out
                    parts, whole, n_whole, held_n = [], [], 0, 0
        if held_n and (out := flush()) is not None:
            yield out
        tidy()

    return docs.mapInArrow(scan, ENTRY)


REPLY = "task long, ids binary, off binary, starts binary, low binary, grp binary"


def _reply(task, ids, off, starts, low, group=None):
    """Occurrences of groups as one row a task."""
    if len(task):
        tasks, at = np.unique(task, return_inverse=True)
        order = np.lexsort((off, ids, at))
        edges, out = np.searchsorted(at[order], np.arange(len(tasks) + 1)), []
        for p in range(len(tasks)):
            o = order[edges[p] : edges[p + 1]]
            out.append((int(tasks[p]), _steps(ids[o]), _small(off[o].astype(np.uint8)), _small(starts[o].astype(np.uint8)), _steps(low[o]), None if group is None else _small(group[o])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] + [pa.binary()] * 5, strict=True)], ["task", "ids", "off", "starts", "low", "grp"])


def _collected(rows):
    get = lambda name, kind, read=_array: np.concatenate([read(r[name], kind) for r in rows])
    h = np.concatenate([_from_six(r["hashes"]) for r in rows])
    task = np.concatenate([np.full(len(r["hashes"]) // 6, r["task"], np.int64) for r in rows])
    low = get("low", np.int64, _summed)
    return get, h, task, get("ids", np.int32, _summed), low, low + get("high", np.int64), get("wins", np.uint8).astype(np.int64)


def _by_bucket(batches):
    """(bucket, rows) of rows that come bucket by bucket: one at a time is held."""
    now, mine = None, []
    for b in batches:
        for r in b.to_pylist():
            if mine and r["bucket"] != now:
                yield now, mine
                mine = []
            now = r["bucket"]
            mine.append(r)
    if mine:
        yield now, mine


def _buckets(docs: DataFrame) -> int:
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(buckets_for(docs), -(-n // BUCKET_BYTES))


def answer_equal(entries: DataFrame, buckets: int, all_: bool) -> DataFrame:
    """The groups of the anchors all of whose cuts are equal, and (hashes) of the others. Without ``all_`` only
    occurrences that a smaller document precedes."""

    def solve(batches):
        for bucket, rows in _by_bucket(batches):
            _, h, task, ids, low, high, wins = _collected(rows)
            digest = np.concatenate([np.frombuffer(r["digests"], np.uint64) for r in rows])
            rows.clear()
            names, group = np.unique(h, return_inverse=True)
            n = len(names)
            a, z = np.full(n, U64(2**64 - 1)), np.zeros(n, np.uint64)
            least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(a, group, digest)
            np.maximum.at(z, group, digest)
            np.minimum.at(least, group, low)
            np.maximum.at(most, group, high)
            equal = a == z
            on = equal[group] & ((least < most)[group] if all_ else least[group] < high)
            gid = (np.int64(bucket) << 33 | group) if all_ else None
            for b in _reply(task[on], ids[on], np.zeros(int(on.sum()), np.int64), wins[on], least[group][on], gid[on] if all_ else None):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], [*b.schema.names, "hashes"])
            if not equal.all():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 5, pa.array([_six(names[~equal])], pa.binary())], ["task", "ids", "off", "starts", "low", "grp", "hashes"])
        tidy()

    dealt = entries.select("task", "bucket", "hashes", "ids", "low", "high", "wins", "digests").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return save(dealt.mapInArrow(solve, REPLY + ", hashes binary"), "equal")


def answer(entries: DataFrame, buckets: int, all_: bool) -> DataFrame:
    """The groups of anchors with several cuts. Without ``all_`` only occurrences that a smaller document precedes."""

    def solve(batches):
        for bucket, rows in _by_bucket(batches):
            yield from _solve(bucket, rows)
        tidy()

    def _solve(bucket, rows):
        get, h, task, ids, low, high, wins = _collected(rows)
        size, data = get("sizes", np.uint8).astype(np.int64), get("cuts", np.uint8)
        rows.clear()
        offset = np.cumsum(size) - size
        _, one, cut = np.unique(span_hashes(data, offset, offset + size), return_index=True, return_inverse=True)
        cut_low, cut_high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(cut_low, cut, low)
        np.maximum.at(cut_high, cut, high)
        n_of, begin_of = wins[one], offset[one]
        entries_of = np.argsort(cut, kind="stable")
        edge_of = np.searchsorted(cut[entries_of], np.arange(len(one) + 1))

        def told(group, c, off, starts, least):
            """Occurrences in cuts, as occurrences in the entries of each."""
            n = edge_of[c + 1] - edge_of[c]
            r = np.repeat(np.arange(len(c)), n)
            e = entries_of[np.repeat(edge_of[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if not all_:
                on = least[r] < high[e]
                r, e = r[on], e[on]
            gid = np.int64(bucket) << 33 | np.int64(1 << 32) | group[r] if all_ else None
            return _reply(task[e], ids[e], off[r], starts[r], least[r], gid)

        hs = h[one]
        order = np.argsort(hs, kind="stable")
        same = np.concatenate([[False], hs[order][1:] == hs[order][:-1]])
        several = same.copy()
        several[:-1] |= same[1:]
        todo = order[several]
        leaf = order[~several]  # anchors with one cut: a tree of one leaf
        leaf = leaf[cut_low[leaf] < cut_high[leaf]]
        yield from told(np.arange(len(leaf)), leaf, np.zeros(len(leaf), np.int64), n_of[leaf], cut_low[leaf])
        number = len(leaf)
        for a, z in _groups(hs[todo], n_of[todo]):
            t = todo[a:z]
            reps, start = n_of[t], begin_of[t]
            inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            begin, c = np.repeat(start, reps) + inside, np.repeat(t, reps)
            group, member, starts, least = repeat_groups(data, begin, np.repeat(start + size[one][t], reps), np.repeat(start, reps), cut_low[c], cut_high[c])
            for lo, hi in portions((edge_of[c[member] + 1] - edge_of[c[member]]).tolist(), 1_000_000):
                m = member[lo:hi]
                yield from told(group[lo:hi] + number, c[m], inside[m], starts[lo:hi], least[lo:hi])
            number += int(group[-1]) + 1 if len(group) else 0

    dealt = entries.select("task", "bucket", "hashes", "ids", "low", "high", "sizes", "wins", "cuts").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(solve, REPLY)


def _groups(h: np.ndarray, weight: np.ndarray, most: int = 60_000):
    """Ranges of whole anchors with about so many strings together."""
    edge = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h)) if len(h) else np.zeros(1, np.int64)
    total = np.concatenate([[0], np.cumsum(weight)])
    lo = 0
    for z in edge[1:]:
        if total[z] - total[lo] >= most or z == len(h):
            yield lo, int(z)
            lo = int(z)


def _occurrences(docs: DataFrame, all_: bool, emit, schema: str) -> DataFrame:
    """``emit(entry of each use, where the cut begins, row, document, (ids, off, starts, low, group))`` for each task that
    has answers."""
    buckets = _buckets(docs)
    equal = answer_equal(cut_out(docs, buckets, "digests"), buckets, all_)
    release(docs.sparkSession)
    only = bitmap_of(equal.where("task is null").select("hashes"))
    known = equal.where("task is not null").drop("hashes")
    replies = known.unionByName(answer(cut_out(docs, buckets, "cuts", only), buckets, all_)).withColumn("kind", F.lit(1))
    own = cut_out(docs, buckets, "own").select("task", F.lit(0).alias("kind"), F.col("uses").alias("ids"), F.col("at").alias("off"), F.col("rows").alias("starts"), "low", F.lit(None).cast("binary").alias("grp"))
    both = own.unionByName(replies).repartition(buckets, "task").sortWithinPartitions("task", "kind")

    def run(batches):
        now, mine, parts = None, None, []

        def told():
            if mine is None or not parts:
                return None
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(found[0], kind="stable")
            return emit(*mine, [x[order] for x in found])

        for b in batches:
            for r in b.to_pylist():
                if r["task"] != now:
                    if (out := told()) is not None:
                        yield out
                    now, mine, parts = r["task"], None, []
                if r["kind"] == 0:
                    mine = _summed(r["ids"], np.int32), _summed(r["off"], np.int32).astype(np.int64), _summed(r["starts"], np.int64), _summed(r["low"], np.int64)
                else:
                    ids = _summed(r["ids"], np.int32)
                    parts.append((ids, _array(r["off"], np.uint8), _array(r["starts"], np.uint8), _summed(r["low"], np.int64), _array(r["grp"], np.int64) if all_ else ids))
        if (out := told()) is not None:
            yield out

    return both.mapInArrow(tidied(run), schema)


def _met(uses, ids):
    """Pairs (use, answer) of equal entries; answers are sorted by entry."""
    lo, hi = np.searchsorted(ids, uses, "left"), np.searchsorted(ids, uses, "right")
    n = hi - lo
    return np.repeat(np.arange(len(uses)), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def maximal_repeat_groups(docs: DataFrame) -> DataFrame:
    """(group, length, doc_id, start): every occurrence of every maximal repeat of ``LENGTH`` bytes or more that lies in
    two documents or more; a row an occurrence, so that no group is gathered. Start and length are bytes of the text.

    A repeat reaches as far as the strings of its anchor do (see above). Null text: the empty one. Rows of equal doc_id
    are one document here; a null doc_id counts as the smallest and comes back as null. An empty table gives no rows.
    """
    docs = _numbered(docs)

    def emit(uses, at, rows, owner, found):
        ids, off, starts, _, group = found
        o, r = _met(uses, ids)
        where, doc = at[o] + off[r], owner[o]
        return pa.RecordBatch.from_arrays([pa.array(group[r]), pa.array(starts[r].astype(np.int64) + LENGTH - 1), pa.array(doc, mask=doc == NONE), pa.array(where)], ["group", "length", "doc_id", "start"])

    return _occurrences(docs, True, emit, "group long, length long, doc_id long, start long")


def repeats(docs: DataFrame) -> DataFrame:
    """(row, spans): per row the runs of bytes (packed int32 pairs, end exclusive) that groups with a smaller document
    cover. Rows without any are absent."""

    def emit(uses, at, rows, owner, found):
        ids, off, starts, low, _ = found
        o, r = _met(uses, ids)
        hit = low[r] < owner[o]
        o, r = o[hit], r[hit]
        if not len(o):
            return None
        row, a = rows[o], at[o] + off[r]
        z = a + starts[r] + LENGTH - 1
        order = np.lexsort((a, row))
        row, a, z = row[order], a[order], z[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(row))
        spans = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            reach = np.maximum.accumulate(z[i:j])  # runs that touch are one
            new = np.flatnonzero(np.concatenate([[True], a[i + 1 : j] > reach[:-1]]))
            spans.append(np.stack([a[i:j][new], reach[np.append(new[1:], j - i) - 1]], 1).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(row[edge[:-1]]), pa.array(spans, pa.binary())], ["row", "spans"])

    # a row's occurrences lie in one task, but may lie in two flushes of it
    found = _occurrences(docs, False, emit, "row long, spans binary")
    return found.groupBy("row").agg(F.array_join(F.transform(F.collect_list("spans"), F.hex), "").alias("spans"))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Removes from every text the bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a
    smaller doc_id: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and on request kept (bytes left) and spans.

    Null text: the empty one. Texts under ``LENGTH`` bytes are kept whole. Rows of equal doc_id do not remove each
    other; a null doc_id counts as the smallest. An empty table gives no rows. Other columns are ignored. The input
    must be the same at each read (a stored table), since row numbers are taken from its scan.
    """
    docs = _numbered(docs)
    found = save(repeats(docs), "repeats")
    release(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(bloom(found, "row"))
    more = ", kept binary, spans array<struct<start:long,end:long>>" if texts else ""

    def apply(batches):
        for b in batches:
            out = []
            for text, told, packed in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "packed")), strict=True):
                runs = []
                if packed:
                    text = zstandard.ZstdDecompressor().decompress(text)
                if told:
                    s = np.frombuffer(bytes.fromhex(told), np.int32).reshape(-1, 2)
                    for a, z in s[np.argsort(s[:, 0], kind="stable")].tolist():
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], z)
                        else:
                            runs.append([a, z])
                kept, last = [], 0
                for a, z in runs:
                    kept.append(text[last:a])
                    last = z
                kept = b"".join([*kept, text[last:]])
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *((kept, [{"start": a, "end": z} for a, z in runs]) if texts else ())))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))], strict=False)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if texts else [])])

    def part(some: bool):
        def pick(batches):
            for b in batches:
                on = bloom_has(held.value, np.array(b.column("row"), np.int64))
                b = b.filter(pa.array(on if some else ~on))
                texts = [_small(t) for t in as_bytes(b.column("text"))] if some else as_bytes(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(texts, pa.binary())], ["row", "doc_id", "text"])

        return docs.mapInArrow(pick, "row long, doc_id long, text binary")

    # a text outside the bitmap loses nothing and stays where it is; the others meet their spans
    hit = part(True).join(found.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans", F.lit(True).alias("packed"))
    rest = part(False).select("doc_id", "text", F.lit(None).cast("string").alias("spans"), F.lit(False).alias("packed"))
    return hit.mapInArrow(apply, OUT + more).unionByName(rest.mapInArrow(apply, OUT + more))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
