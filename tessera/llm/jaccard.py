"""Operator 5, n-gram Jaccard join: size-aware, heavy-light.

Exact: two documents link when their shingle sets have a Jaccard likeness of at least num / den.

1. A count sketch over all shingles, with slots in proportion to the texts up to 2^24, gives every worker the same total
   order, rare shingles first.
2. With overlap c(n) = ceil(t n) needed by a set of n, similar sets share l shingles among their first n - c(n) + l.
   Small sets enumerate all subsets of two of those (l = 2); large sets put the first n - c(n) + 1 into inverted
   lists (l = 1). Sets of just under the boundary are in both, so that they meet large partners. The boundary is the
   size at which the estimated total cost of both is least.
3. Lists are dealt by key in packed blobs. Short lists give candidate pairs. The sets of a long list are never all
   paired up: each is compared with the list's hub, the set with the fewest shingles of its own (the text that near copies
   were made from, if there is one). Lists that then hold sets of one component are done. The others that share sets form
   a super group, cut into blocks; blocks that hold one and the same component only are not compared, other pairs of
   blocks are, in memory, and only the edges of a spanning forest leave them.
4. Candidates that a parity sketch of their sets does not rule out are verified on whole sets; links are joined into
   components.

Scale: equal sets are one node from the first step on (dropped per task before the shuffle), so copies cost a small
row each. No list, group or component is collected; broadcast are the sketch and a bitmap, both bounded, and at most
100 000 hubs. A set is known by 128 bits of a cryptographic hash; lists carry 63 of these, and where two sets should share
them both are verified. What stays quadratic are sets that share rare shingles, more than 48 of them, without being alike:
they are compared block by block.
"""

from __future__ import annotations

import hashlib
import zlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, _with_least, as_bytes, bloom, bloom_has, buckets_for, column, components, deal, discard, given_names, mix, plain_names, portions, release, save, shingles, tidied, tree, unused, word_hashes

SKETCH, MOST_SKETCH = 1 << 20, 1 << 24  # slots of the sketch, least and most
SLOT_BYTES = 384  # a slot for so many bytes of text, some 64 shingles, so that common shingles stand out at any size
SIZES = 4096
LONG_LIST = 48
LEAST_PARITY, MOST_PARITY = 512, 1 << 16
BLOCK_SETS, BLOCK_BYTES = 512, 8 << 20
NONE = -(2**63)


def full_of(s: np.ndarray) -> bytes:
    """The name of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(full: bytes) -> int:
    """What lists carry of it."""
    return int.from_bytes(full[:8], "little") >> 1


def parity_of(s: np.ndarray) -> np.ndarray:
    """For each of m hash slots, whether it holds an odd number of items; m is a power of two, about 1.5 n."""
    m = min(MOST_PARITY, max(LEAST_PARITY, 1 << (3 * len(s) // 2).bit_length()))
    odd = (np.bincount((s & U64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sets(batch, width: int):
    """The shingle set of every text of a batch: sorted distinct hashes."""
    texts = as_bytes(batch.column("text"))
    for lo, hi in portions([len(t) for t in texts]):
        words, edges, *_ = word_hashes([t.lower() for t in texts[lo:hi]])  # of bytes: A-Z only
        runs = shingles(words, width)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield np.unique(runs[a : z - width + 1] if z - a >= width else shingles(words[a:z], z - a))


def sketch_slots(docs: DataFrame) -> int:
    """The slots of the sketch: in proportion to the texts, between fixed bounds."""
    n = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLOT_BYTES
    return min(MOST_SKETCH, max(SKETCH, 1 << n.bit_length()))


def slots_of(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (s >> U64(65 - len(counts).bit_length())).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences by hash slot, up to 65535, number of sets by size up to SIZES) over all documents."""
    slots = sketch_slots(docs)

    def count(batches):
        total = np.zeros(slots + SIZES + 1, np.uint32)
        counts = total[:slots]
        for b in batches:
            for s in _sets(b, width):
                total[slots + min(len(s), SIZES)] += np.uint32(1)
                np.add.at(counts, slots_of(s, counts), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total, 1)], pa.binary())], ["blob"])

    def add(a, b):
        total = np.frombuffer(zlib.decompress(a), np.uint32).copy()
        total += np.frombuffer(zlib.decompress(b), np.uint32)
        return zlib.compress(total, 1)

    blob = tree(docs.select("text").mapInArrow(tidied(count), "blob binary"), add)
    total = np.zeros(slots + SIZES + 1, np.uint32) if blob is None else np.frombuffer(zlib.decompress(blob), np.uint32)
    return np.minimum(total[:slots], 65535).astype(np.uint16), total[slots:].astype(np.int64)


def boundary(counts: np.ndarray, sizes: np.ndarray, num: int, den: int, verify: float = 4.0) -> int:
    """The largest size whose sets enumerate subsets of two: where the summed cost of keys and of co-members in lists
    is least. Lists are estimated from the rarest (1 - t) of all shingle occurrences."""
    total = int(counts.sum(dtype=np.int64))
    if not total:
        return 0
    rare, slots = np.unique(counts[counts > 0], return_counts=True)
    held = rare.astype(np.int64) * slots
    k = np.searchsorted(np.cumsum(held), total * (den - num) / den) + 1
    noise = total / len(counts)
    length = float(np.average(np.maximum(1, rare[:k] - noise), weights=held[:k]))
    n = np.arange(SIZES + 1)
    spare = n - -(-num * n // den)
    subsets = np.array([comb(int(d) + 2, 2) for d in spare], float) * sizes
    lists = (spare + 1) * (1 + verify * (length - 1)) * sizes
    cost = np.cumsum(subsets) + (lists.sum() - np.cumsum(lists))
    return int(cost.argmin())


def base_and_lists(docs: DataFrame, width: int, num: int, den: int, counts: np.ndarray, bound: int):
    """(saved table, documents with their sets' names, key lists): the two outputs of one scan, saved together. ``rare``
    is the number of shingles of a set that hardly any other has."""
    held = docs.sparkSession.sparkContext.broadcast(counts)
    buckets = buckets_for(docs)
    band = -(-num * (bound + 1) // den)
    noise = 1 + int(counts.sum(dtype=np.int64)) // len(counts)  # what a slot holds on average, and one of its own

    def run(batches):
        seen, names = set(), ["doc_id", "n", "node", "full", "rare", "parity", "bucket", "keys", "nodes", "sizes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        order_of = held.value
        out: list[tuple[np.ndarray, int, int]] = []
        amount = 0

        def dealt():
            keys = np.concatenate([k for k, _, _ in out])
            reps = [len(k) for k, _, _ in out]
            nodes, sizes = np.repeat(np.array([x for _, x, _ in out], np.int64), reps), np.repeat(np.array([x for _, _, x in out], np.int32), reps)
            rows = list(deal(((keys >> U64(8)) % U64(buckets)).astype(np.int64), buckets, keys, nodes, sizes))
            p, *blobs = zip(*rows, strict=True)
            none = [None] * len(p)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([none] * 6 + [p, *blobs], kinds, strict=True)], names)

        for b in batches:
            n_of, node, full, rare, parity = [], [], [], [], []
            for s in _sets(b, width):
                n = len(s)
                n_of.append(n)
                full.append(name := full_of(s) if n else None)
                node.append(x := node_of(name) if n else None)
                parity.append(parity_of(s))
                freq = order_of[slots_of(s, order_of)]
                rare.append(int((freq <= noise).sum()))
                if n < 2 or name in seen:  # a set of one links with equal sets only
                    continue
                seen.add(name)
                need = -(-num * n // den)
                first = s[np.argsort(freq, kind="stable")[: n - need + 2]]
                if n <= bound:
                    i, j = np.triu_indices(len(first), 1)
                    keys = mix(first[i] * U64(3) + first[j])
                    out.append((keys, x, n))
                    amount += len(keys)
                if n >= band:
                    keys = mix(first[: n - need + 1] + U64(0x5851F42D4C957F2D))
                    out.append((keys, x, n))
                    amount += len(keys)
            none = pa.nulls(len(n_of), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_of, pa.int64()), pa.array(node, pa.int64()), pa.array(full, pa.binary()), pa.array(rare, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.nulls(len(n_of), pa.int32()), none, none, none], names)
            if amount > 1_500_000:
                yield dealt()
                out, amount = [], 0
        if out:
            yield dealt()

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n long, node long, full binary, rare long, parity array<long>, bucket int, keys binary, nodes binary, sizes binary")
    both = save(both, "jaccard")
    lists = both.where("bucket is not null").select("bucket", "keys", "nodes", "sizes").repartition(buckets, "bucket")
    return both, both.where("bucket is null").select("doc_id", "n", "node", "full", "rare", "parity"), lists


def candidates(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (long, a, b): pairs of nodes of short lists; of a long list (key, node)."""

    def run(batches):
        keys, nodes, sizes = [], [], []
        for b in batches:
            for k, x, n in zip(b.column("keys").to_pylist(), b.column("nodes").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                keys.append(np.frombuffer(k, np.uint64))
                nodes.append(np.frombuffer(x, np.int64))
                sizes.append(np.frombuffer(n, np.int32))
        if not keys:
            return
        k, x, n = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)
        del keys, nodes, sizes
        order = np.argsort(k, kind="stable")
        alone = k[order]
        many = np.concatenate([[False], alone[1:] == alone[:-1]])
        many[:-1] |= many[1:]
        order = order[many]  # only keys that occur twice go on
        k, x, n = k[order], x[order], n[order]
        order = np.lexsort((x, n, k))
        k, x, n = k[order], x[order], n[order]
        again = np.concatenate([[False], (k[1:] == k[:-1]) & (x[1:] == x[:-1])]) if len(k) else np.zeros(0, bool)
        k, x, n = k[~again], x[~again], n[~again]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(k)))
        each = np.repeat(length, length)
        heavy = each > LONG_LIST
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(heavy.sum(), bool)), pa.array((k[heavy] >> U64(1)).astype(np.int64)), pa.array(x[heavy])], ["long", "a", "b"])
        k, x, n = k[~heavy], x[~heavy], n[~heavy].astype(np.int64)
        found = []
        for d in range(1, LONG_LIST):
            if d >= len(k):
                break
            i = np.flatnonzero((k[d:] == k[:-d]) & (n[:-d] * den >= n[d:] * num))  # by size within a list
            if not len(i):
                if not (k[d:] == k[:-d]).any():
                    break
                continue
            found.append(np.stack([np.minimum(x[i], x[i + d]), np.maximum(x[i], x[i + d])]))
        if found:
            a, b = np.concatenate(found, axis=1)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(new.sum(), bool)), pa.array(a[new]), pa.array(b[new])], ["long", "a", "b"])

    return save(lists.mapInArrow(tidied(run), "long boolean, a long, b long"), "candidates")


def named(base: DataFrame) -> DataFrame:
    """(id, node, n, rare, parity) of each set; ``id`` begins with the smallest doc_id that has it, so that a component's
    smallest id tells the smallest document."""
    known = base.where("node is not null").groupBy("full").agg(
        F.min(F.coalesce("doc_id", F.lit(NONE))).alias("own"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("parity").alias("parity")
    )
    return known.select(F.struct("own", "full").alias("id"), "node", "n", "rare", "parity")


def plausible(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): ids of pairs of nodes that may link. The bits in which two parity sketches differ are a lower bound of the
    sets' symmetric difference, which a link bounds from above. Loses none."""
    side = lambda c: known.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_p"))
    # the upper half of the longer sketch is folded onto its lower half; likely sizes are within a factor of two
    half = lambda p, m: F.zip_with(F.slice(p, 1, m), F.slice(p, m + 1, m), lambda x, y: x.bitwiseXOR(y))
    a, b = F.col("a_p"), F.col("b_p")
    a, b = F.when(F.size(a) == 2 * F.size(b), half(a, F.size(b))).otherwise(a), F.when(F.size(b) == 2 * F.size(a), half(b, F.size(a))).otherwise(b)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    differ = F.when(F.size(a) == F.size(b), differ).otherwise(0)
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(differ * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num))
    return near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(full, items): the sets of the wanted documents; texts outside the bitmap are not split. The bitmap's false
    positives can bring a set twice, which does no harm."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "doc_id"))

    def run(batches):
        seen = set()
        for b in batches:
            on = bloom_has(held.value, np.array(b.column("doc_id").fill_null(NONE), np.int64))
            b = b.filter(pa.array(on))
            nodes, items = [], []
            for s in _sets(b, width):
                if len(s) and (x := full_of(s)) not in seen:
                    seen.add(x)
                    nodes.append(x)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(items, pa.binary())], ["full", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidied(run), "full binary, items binary")


def _likeness_ok(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


ID = "struct<own:long,full:binary>"


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link."""
    s = lambda c: sets.select(F.col("full").alias(f"{c}_full"), F.col("items").alias(f"{c}_items"))

    def run(batches):
        for b in batches:
            ok = [_likeness_ok(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(b.column("a_items").to_pylist(), b.column("b_items").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.withColumns({"a_full": F.col("a.full"), "b_full": F.col("b.full")}).join(s("a"), "a_full").join(s("b"), "b_full")
    return both.select("a", "b", "a_items", "b_items").mapInArrow(tidied(run), f"a {ID}, b {ID}")


def with_hubs(members: DataFrame) -> DataFrame:
    """(a, b): each member (key, id, rare) of a long list and the list's hub."""
    pairs = members.select(F.col("key").alias("u"), F.struct("rare", "id").alias("v"))
    return _with_least(pairs, pairs.count()).where("v <> m").select(F.col("v.id").alias("a"), F.col("m.id").alias("b")).distinct()


def compare_blocks(members: DataFrame, linked: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning edges between the components so far (node, root) of the super groups of long lists (key, id); a set
    without a component is one of its own. Sets are dealt into blocks of their super group; a component of more than a
    block has blocks to itself, which are not compared with each other."""
    # of hubs there is a component in nearly every row, so components meet members without a shuffle of one key
    told = members.join(linked.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("part"))
    mixed = told.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    open_ = save(told.join(mixed, "key", "left_semi"), "open")
    edges = open_.select(F.struct(F.lit(0).alias("kind"), F.col("key").alias("key"), F.struct(F.lit(0).cast("long").alias("own"), F.unhex(F.lit("")).alias("full")).alias("id")).alias("a"), F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("key"), F.col("id").alias("id")).alias("b"))
    group = components(edges).where("node.kind = 1").select(F.col("node.id").alias("id"), F.xxhash64("root").alias("root"))
    group = save(group.join(open_.select("id", "part").distinct(), "id"), "groups")
    size = group.groupBy("root", "part").agg(F.count("*").alias("m"))
    whole = size.groupBy("root").agg(F.sum("m").alias("all"))
    alone = size.where(F.col("m") > BLOCK_SETS).select("root", "part", F.ceil(F.col("m") / BLOCK_SETS).alias("nb"))
    rest = group.join(alone, ["root", "part"], "left").join(whole, "root")
    n_blocks = F.coalesce("nb", F.ceil(F.col("all") / BLOCK_SETS)).cast("int")
    own = F.when(F.col("nb").isNotNull(), F.xxhash64("part")).otherwise(0)
    placed = save(rest.select("root", "id", "part", F.struct(own.alias("of"), F.pmod(F.hash("id"), n_blocks).alias("k")).alias("block")).join(sets.withColumnRenamed("full", "name"), F.col("id.full") == F.col("name")).drop("name"), "blocks")
    blocks = placed.select("root", "block").distinct()
    i, j = blocks.select("root", F.col("block").alias("i")), blocks.select("root", F.col("block").alias("j"))
    duty = i.join(j, "root").where("i <= j and (i.of = 0 or i.of <> j.of)")
    first = duty.withColumn("block", F.col("i")).join(placed, ["root", "block"])
    second = duty.where("i <> j").withColumn("block", F.col("j")).join(placed, ["root", "block"])
    rows = first.withColumn("left", F.lit(True)).unionByName(second.withColumn("left", F.lit(False))).select("root", "i", "j", "left", "id", "part", "items")
    kind = pa.struct([("own", pa.int64()), ("full", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, parts = t.column("id").to_pylist(), [(x["own"], x["full"]) for x in t.column("part").to_pylist()]
        sets_ = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        size, on = np.array([len(x) for x in sets_]), np.array(t.column("left"))
        same = key[1] == key[2]
        left, right = np.flatnonzero(on), np.flatnonzero(on if same else ~on)
        number = {p: k for k, p in enumerate(dict.fromkeys(parts))}
        part = np.array([number[p] for p in parts])
        a, b = [], []
        if len(left) and len(right):
            pool, who = np.concatenate([sets_[r] for r in right]), np.repeat(np.arange(len(right)), size[right])
            order = np.argsort(pool, kind="stable")
            pool, who = pool[order], who[order]
            root = np.arange(len(number))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x in left:
                lo, hi = np.searchsorted(pool, sets_[x], "left"), np.searchsorted(pool, sets_[x], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(who[at], minlength=len(right))
                for y in right[den * both >= num * (size[x] + size[right] - both)]:
                    if (u := find(part[x])) != (v := find(part[y])):
                        root[u] = v
                        a.append(ids[x])
                        b.append(ids[y])
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    out = save(rows.groupBy("root", "i", "j").applyInArrow(run, f"a {ID}, b {ID}"), "edges")
    discard(open_, group, placed)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable by links, itself included.

    ``num`` / ``den`` must be over one half: below that sets of one shingle would link with larger ones.

    Null or empty text, or one without words: an empty set, linked with nothing (its own component). Fewer words than
    ``width``: the whole sequence is the one shingle. Rows of equal doc_id stand for themselves; a null doc_id counts
    as the smallest and comes back as null. An empty table gives no rows. Other columns are ignored.
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the least likeness must be over 1/2 and at most 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, sizes = sketch(docs, width)
    bound = boundary(counts, sizes, num, den)
    saved, base, lists = base_and_lists(docs, width, num, den, counts, bound)
    found, known = candidates(lists, num, den), named(base)
    pairs = save(plausible(found.where("not long").select("a", "b").distinct(), known, num, den), "pairs")
    members = found.where("long").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct()
    members = save(members.join(known.select("node", "id", "rare"), "node").select("key", "id", "rare"), "members")
    discard(found)
    release(docs.sparkSession)  # what lists and names were moved for is written
    some = members.head(1)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).select(F.col("id.own").alias("doc_id"))
    sets = save(sets_of(docs, wanted, width), "sets")
    edges = verify(pairs, sets, num, den)
    if some:
        edges_ = save(edges.unionByName(verify(with_hubs(members), sets, num, den)), "edges")
        edges = edges_.unionByName(compare_blocks(members.select("key", "id"), components(edges_), sets, num, den))
    linked = components(edges).select(F.col("node.full").alias("name"), F.col("root.own").alias("low"))
    # copies of a set, too, have its smallest document; what is alone needs no look-up
    id_ = F.coalesce("doc_id", F.lit(NONE))
    copies = base.where("node is not null").groupBy("full").agg(F.min(id_).alias("own"), F.count("*").alias("k"))
    told = copies.join(linked, F.col("full") == F.col("name"), "left").where("k > 1 or low is not null")
    told = save(told.select(F.col("full").alias("name"), F.coalesce("low", "own").alias("low")), "told")
    out = base.select("doc_id", "n", "full").join(told, F.col("full") == F.col("name"), "left")  # saved on both sides: a hot set can be split
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.nullif(F.coalesce("low", id_), F.lit(NONE)).alias("component_id"))
    discard(pairs, members, sets, *([edges_] if some else []))
    release(docs.sparkSession)
    out._scratch = [saved, told]
    return out


def representatives(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is its component's smallest; of rows with an equal doc_id in one
    component one stays. Documents with an empty set (null text too) all stay. A null doc_id counts as the smallest. An
    empty table gives no rows. Columns of any name are kept. Texts stay where they are but for those whose doc_id is not kept
    or shared, and a bitmap's false positives, which are shuffled by doc_id."""
    told = jaccard_components(docs, width, num, den)
    key, other, full, empty = (unused(c, docs) for c in ("kept", "other", "full", "empty"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    told_of = told.groupBy(F.col("doc_id").alias(other)).agg(F.count_if(kept & (F.col("n_shingles") > 0)).alias(full), F.max((kept & (F.col("n_shingles") == 0)).cast("int")).alias(empty))
    odd = save(told_of.where(F.col(full) + F.col(empty) != 1), "odd")  # ids that go, or that several rows share
    discard(*told._scratch)
    release(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(bloom(odd, other))
    docs, given = plain_names(docs)
    own = [column(c) for c in docs.columns]
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))

    def part(some: bool):
        def pick(batches):
            for b in batches:
                on = bloom_has(held.value, np.array(b.column(key).fill_null(NONE), np.int64))
                yield b.filter(pa.array(on if some else ~on))

        return rows.mapInArrow(tidied(pick), rows.schema)

    joined = part(True).join(odd.hint("merge"), F.col(key).eqNullSafe(F.col(other)), "left")
    one = part(False).select(own).unionByName(joined.where(F.col(full).isNull()).select(own))
    # rows that share their doc_id: those of the component's own texts meet once more
    again = joined.where(F.col(full) + F.col(empty) > 1).select(own)
    return given_names(one.unionByName(again.dropDuplicates(["doc_id", "text"])), given)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)
