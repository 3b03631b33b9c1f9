"""Life of facts: duplicates, contradictions, retirement, soft deletes, validation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as X
from tessera.sources.scratch import keep

SIDE_BLOCK = 256  # facts of a side that a task compares with as many of the other


def duplicate_groups(active: DataFrame) -> DataFrame:
    """(key, n, id): a row a member of each group of facts that are equal but for case and white space; the digest of the
    text is the key, so that no text is shuffled, and no group is gathered."""
    keyed = active.select("id", F.sha2(X.normalised("text"), 256).alias("key"))
    n = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(n, "key").select("key", "n", "id")


def consolidation(active: DataFrame) -> DataFrame:
    """(id, superseded_by): all but the newest of each duplicate group."""
    keyed = active.select("id", "created_at_ms", F.sha2(X.normalised("text"), 256).alias("key"))
    newest = keyed.groupBy("key").agg(F.max(F.struct("created_at_ms", "id")).alias("newest"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(newest.select("key", F.col("newest.id").alias("superseded_by")), "key").where("id <> superseded_by").select("id", "superseded_by")


def fact_classes(active: DataFrame, signals=X.SIGNALS) -> DataFrame:
    """(id, created_at_ms, class, terms, sides): facts with a signal word; those with the same meaningful terms and the same
    sides of the signals are one class, however their texts are worded. A side is (signal, 0 or 1)."""
    told = active.select("id", "created_at_ms", X.query_terms("text").alias("all"), F.sort_array(X.meaningful_terms("text")).alias("terms"))
    sides = [F.when(F.array_contains("all", w), F.struct(F.lit(i).alias("signal"), F.lit(s).alias("side"))) for i, (a, b, _) in enumerate(signals) for s, w in ((0, a), (1, b))]
    sided = told.select("id", "created_at_ms", "terms", F.array_compact(F.array(*sides)).alias("sides")).where(F.size("sides") > 0)
    return sided.withColumn("class", F.sha2(F.to_json(F.struct("terms", "sides")), 256))


@dataclass
class _Side:
    """A block of one side: its classes, one row of each, and which facts are theirs."""

    rows: pa.Table
    first: np.ndarray  # of each class the place of one of its facts
    facts: np.ndarray  # places, class after class
    start: np.ndarray
    n: np.ndarray
    on: tuple[np.ndarray, np.ndarray]  # class x signal up to the block's own: whether the class is on this side of it

    @classmethod
    def of(cls, rows: pa.Table, signal: int) -> _Side:
        rows = rows.combine_chunks()
        codes = pc.dictionary_encode(rows["class"].combine_chunks()).indices.to_numpy(zero_copy_only=False)
        _, first, n = np.unique(codes, return_index=True, return_counts=True)
        on = tuple(cls._signals(rows[c].take(pa.array(first)), signal) for c in ("on_0", "on_1"))
        return cls(rows, first, np.argsort(codes, kind="stable"), np.cumsum(n) - n, n, on)

    @staticmethod
    def _signals(lists: pa.ChunkedArray, signal: int) -> np.ndarray:
        lists = lists.combine_chunks()
        of, value = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), signal + 1), np.int32)
        out[of[value <= signal], value[value <= signal]] = 1
        return out

    def terms(self) -> pa.ListArray:
        return self.rows["terms"].take(pa.array(self.first)).combine_chunks()

    def facts_of(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The facts of some classes, and which of these each is of."""
        n = self.n[classes]
        of = np.repeat(np.arange(len(classes)), n)
        return self.facts[self.start[classes][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]], of


def _digests(texts: pa.Array) -> pa.Array:
    """MD5 of each text, as ``md5`` writes it."""
    at, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist(), memoryview(texts.buffers()[2] or b"")
    return pa.array([hashlib.md5(data[i:j]).hexdigest() for i, j in pairwise(at)], pa.string())


def _met(left: _Side, right: _Side, least: int, once: bool, told: str) -> Iterator[tuple]:
    """(places of the left, of the right, what they share, a column each): for each class of the left its pairs with all of the
    right. What a pair of classes shares is told once for all of their facts; as numbers it is counted and never written."""
    mine, theirs = left.terms(), right.terms()
    of_row = np.repeat(np.arange(len(theirs)), pc.list_value_length(theirs).to_numpy(zero_copy_only=False))
    flat = pc.dictionary_encode(theirs.flatten())
    has = np.zeros((len(flat.dictionary) + 1, len(theirs)), bool)  # the last line: terms that none of the other block has
    has[flat.indices.to_numpy(zero_copy_only=False), of_row] = True
    words = mine.flatten()
    at = pc.index_in(words, flat.dictionary).fill_null(len(flat.dictionary)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(mine).to_numpy(zero_copy_only=False))
    earlier = left.on[0][:, :-1] @ right.on[1][:, :-1].T > 0
    both = np.zeros(earlier.shape, bool)
    if once:
        earlier |= left.on[1][:, :-1] @ right.on[0][:, :-1].T > 0
        both = np.outer(left.on[1][:, -1], right.on[0][:, -1]) > 0
    cost = np.maximum(-(-pc.utf8_length(words).to_numpy(zero_copy_only=False) // 4), 1).astype(np.float32)  # ``text.token_estimate`` of a word
    a_id, b_id = (s.rows["id"].to_numpy() for s in (left, right))
    for i, end in enumerate(ends):
        lo = ends[i - 1] if i else 0
        met = has[at[lo:end]]
        n = met.view(np.uint8).sum(axis=0, dtype=np.int32)
        near = np.flatnonzero((n >= least) & ~earlier[i]) if end > lo else np.array([], int)
        if not len(near):
            continue
        if told == "numbers":
            shared = [pa.array(n[near]), pa.array((cost[lo:end] @ met[:, near]).astype(np.int32))]
        else:
            _, k = np.nonzero(np.ascontiguousarray(met[:, near].T))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[near])]), pa.int32()), words.take(pa.array(lo + k)))
            shared = pc.binary_join(lists, " ")
            shared = [_digests(shared) if told == "digest" else shared]
        b, of = right.facts_of(near)
        for a in left.facts[left.start[i] : left.start[i] + left.n[i]]:
            own = np.flatnonzero(~both[i, near[of]] | (a_id[a] < b_id[b]))  # on both sides of the signal: told by one of them
            yield np.full(len(own), a), b[own], *(s.take(pa.array(of[own])) for s in shared)


# What is told of the terms that a pair shares: the words, their MD5, or how many they are and what tokens they cost.
SHARED = {"words": [("shared", T.StringType())], "digest": [("shared", T.StringType())], "numbers": [("n_shared", T.IntegerType()), ("shared_tokens", T.IntegerType())]}


def _opposed(left: DataFrame, right: DataFrame, least_shared: int, once: bool = False, told: str = "words") -> DataFrame:
    """(a, b, signal, shared) of the facts (signal, id, created_at_ms, class, terms, sides) of one side and of the other that
    share enough terms, each pair at the first signal that a opposes b on; with ``once`` (a, a_at, b, b_at, signal, shared) at
    the first that either opposes the other on, and not as (b, a) again. What is shared is told as ``SHARED`` says.

    Facts on opposite sides that talk of anything common share their most usual words, so lists by word would name a pair
    once for each of these; it is cheaper to compare term sets. Both sides are cut into blocks by hash, and a task gets a
    block of each, never a whole signal. Which signal is a pair's first is seen from its own sides, so pairs are not
    gathered again, and what is wanted of a fact comes with it, so pairs are not joined with facts."""
    parts = lambda d, name: d.groupBy("signal").agg(F.ceil(F.count("*") / SIDE_BLOCK).cast("int").alias(name))
    counts = F.broadcast(parts(left, "m").join(parts(right, "n"), "signal"))  # a row a signal
    block = lambda d, own: d.join(counts, "signal").withColumn("of", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    on = lambda k: F.transform(F.filter("sides", lambda x: x["side"] == k), lambda x: x["signal"]).alias(f"on_{k}")
    wanted = [on(0), on(1), *(F.col(c).alias(n) for c, n in (("signal", "signal"), ("id", "id"), ("created_at_ms", "at"), ("class", "class"), ("terms", "terms")))]  # named anew: both sides may be of one table
    x = block(left, "m").select(F.col("of").alias("i"), every("n").alias("j"), *wanted)
    y = block(right, "n").select(every("m").alias("i"), F.col("of").alias("j"), *wanted)
    own = ["id", "at"] if once else ["id"]
    names = ["a", "a_at", "b", "b_at"] if once else ["a", "b"]
    schema = T.StructType([*(T.StructField(n, x.schema[c].dataType) for n, c in zip(names, own * 2, strict=True)), T.StructField("signal", T.IntegerType()), *(T.StructField(n, kind) for n, kind in SHARED[told])])

    def meet(xs: pa.Table, ys: pa.Table) -> pa.Table:
        some = []
        if len(xs) and len(ys):
            signal = xs["signal"][0].as_py()
            some = list(_met(_Side.of(xs, signal), _Side.of(ys, signal), least_shared, once, told))
        a, b = (pa.array(np.concatenate([s[k] for s in some] or [np.array([], int)])) for k in (0, 1))
        shared = [pa.chunked_array([s[2 + k] for s in some], to_arrow_type(kind)) for k, (_, kind) in enumerate(SHARED[told])]
        n = pa.array(np.full(len(a), signal if some else 0, np.int32))
        return pa.table([*(xs[c].take(a) for c in own), *(ys[c].take(b) for c in own), n, *shared], list(schema.names))

    return x.groupBy("signal", "i", "j").cogroup(y.groupBy("signal", "i", "j")).applyInArrow(meet, schema)


def _sided(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts (id, created_at_ms, class, terms, sides) on each side, a row a signal."""
    s = facts.select("id", "created_at_ms", "class", "terms", "sides", F.explode("sides").alias("s")).withColumn("signal", F.col("s.signal"))
    return tuple(s.where(F.col("s.side") == k).drop("s") for k in (0, 1))


def class_conflicts(classes: DataFrame, least_shared: int = 2) -> DataFrame:
    """(a, b, signal, shared): pairs of classes in conflict, a on the first word's side, each with its first signal."""
    once = classes.groupBy("class").agg(F.first("terms").alias("terms"), F.first("sides").alias("sides"))
    rows = once.select(F.col("class").alias("id"), F.lit(None).cast("long").alias("created_at_ms"), "class", "terms", "sides")
    return _opposed(*_sided(rows), least_shared)


def contradiction_classes(active: DataFrame, signals=X.SIGNALS, least_shared: int = 2) -> tuple[DataFrame, DataFrame]:
    """((left, right, signal, shared, pairs), (class, id)): conflicts between classes, each named by its smallest fact, with
    the number of pairs of facts they stand for, and the facts of each class. Copies add to the membership only."""
    facts = keep(fact_classes(active, signals), "facts")
    named = facts.groupBy("class").agg(F.min("id").alias("name"), F.count("*").alias("n"))
    of = lambda c, name: named.select(F.col("class").alias(c), F.col("name").alias(name), F.col("n").alias(f"n_{c}"))
    met = class_conflicts(facts, least_shared).join(of("a", "left"), "a").join(of("b", "right"), "b")
    n = F.when(F.col("a") == F.col("b"), (F.col("n_a") * (F.col("n_a") - 1) / 2).cast("long")).otherwise(F.col("n_a") * F.col("n_b")).alias("pairs")
    names = F.array(*(F.lit(x) for *_, x in signals))
    members = facts.join(named, "class").select(F.col("name").alias("class"), "id")
    return met.select("left", "right", F.element_at(names, F.col("signal") + 1).alias("signal"), "shared", n).where("pairs > 0"), members


def contradictions(active: DataFrame, signals=X.SIGNALS, least_shared: int = 2, some: DataFrame | None = None, digest: bool = False, numbers: bool = False) -> DataFrame:
    """(newer, older, signal, shared): pairs of facts with opposing words and enough meaningful terms in common, so as many
    rows as there are pairs. With ``some`` (id) only pairs of which one is among these facts; with ``digest`` the MD5 of what
    is shared, with ``numbers`` (n_shared, shared_tokens) instead of it."""
    told = "numbers" if numbers else "digest" if digest else "words"
    shared = [n for n, _ in SHARED[told]]
    facts = keep(fact_classes(active, signals).where("id is not null"), "facts")
    if some is None:
        met = _opposed(*_sided(facts), least_shared, True, told)
    else:
        chosen, rest = (_sided(facts.join(F.broadcast(some.select("id").distinct()), "id", how)) for how in ("left_semi", "left_anti"))
        met = _opposed(chosen[0], _sided(facts)[1], least_shared, True, told).unionByName(_opposed(rest[0], chosen[1], least_shared, True, told))
    later = (F.col("a_at") > F.col("b_at")) | ((F.col("a_at") == F.col("b_at")) & (F.col("a") < F.col("b")))
    pairs = met.where("a <> b").select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("newer"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("older"), "signal", *shared)
    if facts.groupBy("id").count().where("count > 1").head(1):  # only then is a pair of ids met again
        pairs = pairs.groupBy("newer", "older").agg(*(F.min_by(c, "signal").alias(c) for c in shared), F.min("signal").alias("signal"))
    names = F.array(*(F.lit(n) for *_, n in signals))
    return pairs.select("newer", "older", F.element_at(names, F.col("signal") + 1).alias("signal"), *shared)


def retire(memories: DataFrame, pairs: DataFrame, now_ms: int) -> DataFrame:
    """Facts with the older of each contradiction ended, by the smallest newer id where there are several."""
    ended = pairs.groupBy("older").agg(F.min("newer").alias("by"))
    return memories.join(ended, memories.id == ended.older, "left").select(
        *[F.col(c) for c in memories.columns if c not in ("valid_to", "superseded_by")],
        F.coalesce("valid_to", F.when(F.col("older").isNotNull(), F.lit(str(now_ms)))).alias("valid_to"),
        F.coalesce("superseded_by", "by").alias("superseded_by"),
    )


def forget(active: DataFrame, query: str, limit: int, now_ms: int) -> DataFrame:
    """(id, valid_to): the best matches of a query, ended now."""
    score = X.recall_score("text", X.query_terms(F.lit(query)), F.lit(query))
    return active.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("created_at_ms"), "id").limit(limit).select("id", "score", F.lit(str(now_ms)).alias("valid_to"))


def validate(writes: DataFrame) -> DataFrame:
    """Adds ``problem`` (null if none) to (text, confidence, sensitivity): what keeps a fact from being written."""
    c = F.col("confidence")
    return writes.withColumn(
        "problem",
        F.when(F.btrim("text") == "", "empty_text").when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), "confidence").when(~F.col("sensitivity").rlike("^[A-Za-z0-9_-]+$"), "sensitivity"),
    )
