"""Helpers that the corpus operators share.

Bytes, words and hashes follow one convention throughout: a text is its UTF-8 bytes (a null text is the
empty one), a word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``, and hashes are 64-bit.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where that is unset and everything runs
    on one machine, as in tests, a folder of the session's own warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives a lost executor, and
    computes its input once (``checkpoint(eager=True)`` would run it twice). ``discard`` deletes it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing will read any more, results that are not computed yet included."""
    for df in tables:
        spark, path = df.sparkSession, df._saved_at
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str):
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with names that ``mapInArrow`` cannot take replaced, and what they were."""
    odd = [c for c in docs.columns if "." in c or "`" in c]
    new, taken = {}, {c.lower() for c in docs.columns}
    for i, c in enumerate(odd):
        name = f"column_{i}"
        while name in taken:
            name += "_"
        new[c] = name
        taken.add(name)
    return docs.select([column(c).alias(new.get(c, c)) for c in docs.columns]), {v: k for k, v in new.items()}


def given_names(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select([F.col(c).alias(names.get(c, c)) for c in docs.columns]) if names else docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls become the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 arrays (wraps around)."""
    h = h ^ (h >> U64(30))
    h = h * MIX_A
    h = h ^ (h >> U64(27))
    h = h * MIX_B
    return h ^ (h >> U64(31))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order."""
    n = len(words) - width + 1
    if n <= 0 or not width:
        return words[:0]
    h = mix(words[:n] + U64(width))
    for k in range(1, width):
        h = mix(h * U64(3) + words[k : n + k])
    return h


def crc_mod(col, modulus: int):
    """crc32 of an id's decimal text, modulo."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def crc_mod_py(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


FAN, MOST_SUMS = 16, 4


def tree(blobs: DataFrame, add) -> bytes | None:
    """Adds up a binary column in a tree on the executors, in DataFrame operations only: those on an RDD run in Python workers
    of their own, which stay alive on every executor beside the others. If a partition has one blob, ``MOST_SUMS`` at
    most reach the driver. None: no row."""

    def sums(batches):
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                total = x if total is None else add(total, x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], ["blob"])

    n = blobs.rdd.getNumPartitions()
    while n > MOST_SUMS:
        n = -(-n // FAN)
        blobs = blobs.repartition(n).mapInArrow(tidied(sums), "blob binary")
    total = None
    for (x,) in blobs.collect():
        total = bytes(x) if total is None else add(total, bytes(x))
    return total


def tree_sum(df: DataFrame, n: int, dtype: str = "int64") -> np.ndarray:
    """Adds up a binary column of zlib-packed (index, amount) pairs into one array of fixed length ``n``.

    What reaches the driver is a few times ``n`` numbers, whatever the input; partial sums meet in a tree on the executors.
    """

    def whole(blob: bytes) -> np.ndarray:
        raw = zlib.decompress(blob)
        k = int.from_bytes(raw[:8], "little")
        total = np.zeros(n, dtype)
        total[np.frombuffer(raw, np.int64, k, 8)] = np.frombuffer(raw, dtype, k, 8 + 8 * k)
        return total

    total = tree(df, lambda a, b: packed(whole(a) + whole(b)))
    return np.zeros(n, dtype) if total is None else whole(total)


def packed(total: np.ndarray) -> bytes:
    """The non-zero entries of an array, for ``tree_sum``."""
    at = np.flatnonzero(total)
    return zlib.compress(len(at).to_bytes(8, "little") + at.astype(np.int64).tobytes() + total[at].tobytes(), 1)


MOST_HUBS, LEAST_HUB = 100_000, 256


def _with_least(pairs: DataFrame, n: int) -> DataFrame:
    """(u, v, m): to each pair the smallest v of its u. Minima are pre-aggregated before their shuffle; those of hubs,
    nodes with so many pairs that there are at most ``MOST_HUBS`` of them, meet their pairs by a broadcast, so that no
    task gets all pairs of one hub; the others meet by an ordinary join."""
    hub = max(LEAST_HUB, 2 * n // MOST_HUBS)
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    hubs, rest = low.where(F.col("k") > hub).select("u", "m"), low.where(F.col("k") <= hub).select("u", "m")
    few = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(rest, "u")
    return pairs.join(F.broadcast(hubs), "u").select("u", "v", "m").unionByName(few.select("u", "v", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: one row (node, root), root the smallest node reachable. Nodes are of
    any type that has an order.

    Alternating large-star and small-star steps, until all edges lead from distinct nodes to nodes that lead nowhere.
    Every round is written to the shared folder and the one before deleted, so no lineage grows; on the driver are
    three numbers. No neighbourhood is collected into a list. Nulls are dropped.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while True:
        roots = e.select(F.col("v").alias("r")).distinct()
        shape = e.groupBy("u").agg(F.count("*").alias("k")).join(roots, F.col("u") == F.col("r"), "left")
        n, most, inner = shape.agg(F.sum("k"), F.max("k"), F.count("r")).first()
        if not n or most == 1 and not inner:
            own = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return own.unionByName(roots.select(F.col("r").alias("node"), F.col("r").alias("root")))
        # large star: every larger neighbour of a node links to the node's smallest neighbour, or to the node
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _with_least(both, 2 * n)
        large = least.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = save(large, "cc")
        # small star: smaller neighbours and the node itself link to the smallest
        least = _with_least(large, n)
        own = least.select("u", F.col("m").alias("v"))
        small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, save(own.unionByName(small).distinct(), "cc")
        discard(old, large)


def permute(i: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1: a Feistel network over the next even number of bits, walked
    until it is back inside the range."""
    if n <= 1:
        return np.zeros_like(i)
    half = (max(2, (n - 1).bit_length()) + 1) // 2
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << U64(half) | right

    out = once(i.astype(np.uint64))
    while (far := out >= U64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


LEAST_BITS, MOST_BITS = 16, 29


def bits_for(n: int, least: int = LEAST_BITS, most: int = MOST_BITS) -> int:
    """The width of slots of a bitmap for n values: sixteen bits a value, between fixed bounds."""
    return min(most, max(least, (16 * max(1, n)).bit_length()))


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap over the values of a long column (null counts as the smallest long), sized by their number up to 64 MB.
    False positives cost time, never results."""
    rows = df.select(F.coalesce(F.col(column).cast("long"), F.lit(-(2**63))).alias("v"))
    size = 1 << bits_for(rows.count()) - 3

    def fill(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            at = bloom_slot(np.array(b.column("v"), np.int64), size)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)])], ["blob"])

    def either(a, b):
        return zlib.compress(np.bitwise_or(np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)).tobytes(), 1)

    bits = tree(rows.mapInArrow(tidied(fill), "blob binary"), either)
    return np.zeros(size, np.uint8) if bits is None else np.frombuffer(zlib.decompress(bits), np.uint8)


def bloom_slot(v: np.ndarray, size: int) -> np.ndarray:
    return (mix(v.view(np.uint64)) & U64(size * 8 - 1)).astype(np.int64)


def bloom_has(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    at = bloom_slot(v, len(bits))
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def deal(bucket: np.ndarray, buckets: int, *columns: np.ndarray):
    """One row a non-empty bucket: (bucket, packed columns). Rows of a shuffle are then blobs of many entries."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), *(c[cuts[p] : cuts[p + 1]].tobytes() for c in columns)


def buckets_for(df: DataFrame, per_partition: int = 2) -> int:
    """Buckets of a packed shuffle: in proportion to the input's partitions, hence of bounded size."""
    return max(12, per_partition * df.rdd.getNumPartitions())


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 21)
        both = [np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
        for p in both:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches start..end of some bytes; they depend on these bytes only."""
    power, back = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + U64(0x2545F4914F6CDD1D) * (end - start).astype(np.uint64))


LONG_WORD = 4096
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches start..end of some bytes: eight bytes a step through a finaliser, so that no pattern
    of bytes makes two stretches meet, as it can in a polynomial modulo 2^64. Long stretches take a cryptographic hash."""
    left = end - start
    h = mix(left.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D))
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    on, at = np.flatnonzero((left > 0) & (left <= LONG_WORD)), start
    while len(on):
        chunk = np.ascontiguousarray(ahead[at[on]]).view(np.uint64).ravel() & _MASKS[np.minimum(left[on], 8)]
        h[on] = mix((h[on] ^ chunk) * U64(0xD6E8FEB86659FD93))
        at, left = at + 8, left - 8
        on = on[left[on] > 0]
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_spans(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts joined by a line feed, edges, start, end): text i has words edges[i]..edges[i+1]. ``between``
    says of each byte whether it is outside words; a line feed must be."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.concatenate([[False], ~between[data]])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    begins = np.cumsum(np.array([0] + [len(t) + 1 for t in texts], np.int64))
    return data, np.searchsorted(turn[::2], begins), turn[::2], turn[1::2]


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, edges, start, end), as ``word_spans``. A word's hash depends on its bytes only; no word becomes
    a Python object."""
    data, edges, start, end = word_spans(texts, between)
    return byte_hashes(data, start, end), edges, start, end


def portions(sizes, most: int = 600_000):
    """Ranges of neighbours whose sizes sum to about ``most``."""
    lo = n = 0
    for i, size in enumerate(sizes):
        n += size
        if n >= most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Sends texts to Python in batches of bounded bytes, whatever their lengths, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def tidied(run):
    """A function over batches that gives freed memory back when its task ends."""

    def all_batches(batches):
        yield from run(batches)
        tidy()

    return all_batches


def tidy() -> None:
    """Gives memory that a task has freed back to the system: idle workers stay alive between stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more, before the next large shuffle;
    it does so when the driver's garbage is collected, which a small driver heap may put off for long."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
