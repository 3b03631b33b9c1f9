"""Operator 9, mixing sources to target weights.

Every source's words, in a fixed order of documents, are packed into blocks of fixed length. Output shards draw
multinomial source counts; a source's draws are numbered across shards and mapped through a pseudorandom permutation
of its block numbers (another one each epoch); the blocks are then joined by source and number.

Scale: texts are scanned once for their sizes. Offsets come from two levels of sums (within hashed chunks, then over
chunks), so no source is ever sorted in one task. Draws have two levels too: the driver splits the sources' slots among
groups of shards, and each group is split among its shards, and these into slots, in a stream on the executors. The
join key (source, block) is at most doubled, so a hot source spreads evenly. What the driver holds is one number a source
and group, ``MOST_DRAWS`` at most; the shards are as many as the mix needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, permute, save, tidied

BLOCK = 64
MOST_SOURCES = 100_000
MOST_GROUPS, MOST_DRAWS = 4096, 1 << 20
SLOTS_A_SHARD = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size): words of every whole text; null text has none."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def count(batches):
        for b in batches:
            n = pa.array([len(t.split()) for t in as_bytes(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("source"), n], ["row", "doc_id", "source", "size"])

    return rows.mapInArrow(tidied(count), "row long, doc_id long, source string, size long")


def targets(totals: list[tuple[str | None, int]], weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last: ``share`` of all sizes by repeating weights, none over
    ``most`` times its size; what is cut off is shared again by weight."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    w = [float(weights[i % len(weights)]) for i in range(len(order))]
    total, goal, free = share * sum(s for _, s in order), [0.0] * len(order), set(range(len(order)))
    left = total
    while free and left > 0:
        part = left / sum(w[i] for i in free)
        over = {i for i in free if w[i] * part > most * order[i][1]}
        if not over:
            for i in free:
                goal[i] = w[i] * part
            break
        for i in over:
            goal[i] = most * order[i][1]
            left -= goal[i]
        free -= over
    return [(s, n, g) for (s, n), g in zip(order, goal, strict=True)]


def draws(quota: np.ndarray, needs: np.ndarray, seed) -> np.ndarray:
    """Slots by part and source: each part draws a multinomial of its need by what the sources have left to give. A source
    that is drawn beyond that is drawn again among the others, so that rows sum to ``needs`` and columns to ``quota``."""
    rng, left, out = np.random.default_rng(seed), quota.astype(np.int64).copy(), np.zeros((len(needs), len(quota)), np.int64)
    for j, need in enumerate(needs.tolist()):
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[j] += got
            left -= got
            need -= int(got.sum())
    return out


def even(total: int, parts: int) -> np.ndarray:
    """Parts of a total that differ by one at most."""
    return np.full(parts, total // parts) + (np.arange(parts) < total % parts)


def groups(quota: np.ndarray, seed: int = 9, slots_a_shard: int = SLOTS_A_SHARD, most_draws: int = MOST_DRAWS) -> list[tuple]:
    """(group, first shard, shards, first draw of each source, draws of each source) of the groups of shards."""
    total = int(quota.sum())
    shards = max(1, -(-total // slots_a_shard))
    n = max(1, min(shards, MOST_GROUPS, most_draws // max(1, len(quota))))
    each = even(shards, n)
    begin = np.cumsum(each) - each
    size = lambda k: total * k // shards  # slots of the shards before k
    drawn = draws(quota, np.array([size(int(b + e)) - size(int(b)) for b, e in zip(begin, each, strict=True)]), [seed, 0])
    first = np.cumsum(drawn, axis=0) - drawn
    return [(g, int(begin[g]), int(each[g]), first[g].tolist(), drawn[g].tolist()) for g in range(n)]


def _offsets(counted: DataFrame, sources: DataFrame, chunks: int) -> DataFrame:
    """Adds source number and the position of a document's first word among its source's words."""
    d = counted.join(F.broadcast(sources), counted.source.eqNullSafe(sources.s_name)).drop("s_name")
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    base = d.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    base = base.withColumn("base", F.sum("words").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.sum("size").over(Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("inner", F.coalesce(inner, F.lit(0)))
    return d.join(base.select("sid", "chunk", F.coalesce("base", F.lit(0)).alias("base")), ["sid", "chunk"]).withColumn("at", F.col("base") + F.col("inner")).drop("base", "inner", "chunk")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, sid, block, lo, hi): the words lo..hi of a document that lie in a block."""
    p = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    return p.select("row", "sid", "block", F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).alias("lo"), F.least((F.col("block") + 1) * block - F.col("at"), F.col("size")).alias("hi"))


def slots(plan: DataFrame, blocks: list[int], total: int, shards: int, seed: int = 9) -> DataFrame:
    """(shard, slot, sid, block) from rows of ``groups``: the group's draws are dealt to its shards, and draw i of a source
    takes block permutation_epoch(i mod blocks). Every shard is seeded by its number, so a task that runs again draws the
    same."""

    def make(batches):
        for b in batches:
            for r in b.to_pylist():
                first, left = np.array(r["first"], np.int64), np.array(r["drawn"], np.int64)
                for shard in range(r["begin"], r["begin"] + r["shards"]):
                    need = total * (shard + 1) // shards - total * shard // shards
                    mine = draws(left, np.array([need]), [seed, 1, shard])[0]
                    yield from shard_slots(shard, first, mine)
                    first += mine
                    left -= mine

    def shard_slots(shard, first, mine):
        slot = 0
        for sid in np.flatnonzero(mine).tolist():
            n = blocks[sid]
            for lo in range(0, int(mine[sid]), 65_536):
                at = np.arange(lo, min(int(mine[sid]), lo + 65_536), dtype=np.int64)
                i, out = at + first[sid], np.empty(len(at), np.int64)
                epoch = i // n
                for e in np.unique(epoch):
                    on = epoch == e
                    out[on] = permute(i[on] % n, n, seed * 1_000_003 + sid * 8191 + int(e))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(slot + at), pa.array(np.full(len(at), sid, np.int64)), pa.array(out)], ["shard", "slot", "sid", "block"])
            slot += int(mine[sid])

    return plan.mapInArrow(tidied(make), "shard long, slot long, sid long, block long")


def plan_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 9, slots_a_shard: int = SLOTS_A_SHARD):
    """(placed documents, slots, sources): the parts of a mix; see ``mix`` and ``mixed_blocks``."""
    spark = docs.sparkSession
    counted = save(sizes(docs), "mix")
    totals = counted.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: merge the small ones first")
    goals = targets([(r["source"], r["size"]) for r in totals], weights, share, most)
    blocks = [-(-n // block) for _, n, _ in goals]
    quota = np.array([min(int(most * k), round(g / n * k)) if n else 0 for (_, n, g), k in zip(goals, blocks, strict=True)], np.int64)
    told = [pa.array(range(len(goals)), pa.int64()), *(pa.array([g[i] for g in goals], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64())))]
    sources = spark.createDataFrame(pa.Table.from_arrays(told, ["sid", "s_name", "source_size", "target"]))
    chunks = 1 << min(16, max(3, (sum(r["n"] for r in totals) // 2000).bit_length()))
    placed = _offsets(counted, sources, chunks)
    total = int(quota.sum())
    rows = groups(quota, seed, slots_a_shard) if total else []
    parts = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    # few rows, but a task's work is what they stand for: dealt one by one
    names = {"grp": pa.int64(), "begin": pa.int64(), "shards": pa.int64(), "first": pa.list_(pa.int64()), "drawn": pa.list_(pa.int64())}
    plan = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(names.items())})).coalesce(1).repartition(parts)
    return placed, slots(plan, blocks, total, max(1, -(-total // slots_a_shard)), seed), sources


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes.

    Null text: size 0, nothing taken. A null source is one source, last. Repeated or null doc_ids: each row stands
    for itself. An empty table gives no rows. Other columns are ignored. Reruns agree: order and draws are seeded.
    """
    placed, drawn, _ = plan_mix(docs, **options)
    # draws are planned from a small table, but are as many as the mix has blocks: they must not be broadcast
    times = drawn.groupBy("sid", "block").agg(F.count("*").alias("times")).hint("merge")
    taken = pieces(placed, options.get("block", BLOCK)).join(times, ["sid", "block"]).groupBy("row").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken")).hint("merge")
    return placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (shard, sid, slot, source, block, part, doc_id, text), a row for each piece of a block in order;
    words are joined by single spaces."""
    placed, drawn, _ = plan_mix(docs, **options)
    cut = pieces(placed, options.get("block", BLOCK))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    words = placed.select("row", "doc_id", "source", "at").join(rows, "row")
    text = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")), " ")
    parts = cut.join(words, "row").select("sid", "block", "source", "doc_id", F.col("at").alias("part"), text.alias("text"))
    return drawn.hint("merge").join(parts, ["sid", "block"]).select("shard", "sid", "slot", "source", "block", "part", "doc_id", "text")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
