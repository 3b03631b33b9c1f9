"""A stored inverted index: postings in blocks, document lengths and content keys, kept up to date, searched with bounds.

A term's postings lie in blocks of about ``BLOCK``, dealt by hash of the document, so that no term, however common, makes a
large row, and the block of a document is known without looking. Postings are counted where a text is read and moved once, packed,
to the other postings of their terms; blocks are made, and written, where they meet. A block knows the highest count and the shortest length
among its postings, which bound what it can add to any score.

A search scores few postings of common terms: the rarest terms of a query give a threshold that the pool's last place
reaches at least; terms that together cannot reach it bring no new document, and of these only the blocks of documents that
are candidates already are opened. The result is that of ``recall.bm25`` over the same texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import recall
from tessera.operators.recall import K1, LEAST_IDF, POOL, B
from tessera.sources.scratch import keep

BLOCK, BUCKETS = 1024, 64
PACK = 1 << 20  # postings that a task packs at once, and that a group of terms has, about
SLACK = 1e-5  # scores are rounded to six digits


@dataclass(frozen=True)
class TextIndex:
    """blocks: term, bucket, block, parts (of the term), n, most (tf), least (length), postings (id, tf, length); documents:
    id, length, key."""

    blocks: DataFrame
    documents: DataFrame

    def write(self, folder: str) -> None:
        """The blocks lie by bucket of their term and in its order, so a search reads the parts of the files it needs. They are
        not moved for it: a group of terms, made in one task, is of one bucket."""
        self.blocks.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/blocks")
        self.documents.write.parquet(f"{folder}/documents")


def read(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/documents"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def block_of(id_: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id_), parts)


def _documents(docs: DataFrame) -> DataFrame:
    """(id, length, key): the key is that of the text, however it is stored."""
    return docs.select("id", X.token_count("text").cast("int").alias("length"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))


def _postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, length) of (id, text), as ``recall.postings``, but counted in the task that reads the text."""
    rows = docs.select("id", X.joined_tokens("text").alias("all"))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("tf", T.LongType()), T.StructField("length", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern(b.column("all"), " ")
            lengths = np.where(pc.binary_length(b.column("all")).to_numpy(zero_copy_only=False) > 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
            portion = np.cumsum(lengths, dtype=np.int64) // recall.BLOCK_TOKENS
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(portion)) + 1, [len(portion)]])
            for lo, hi in pairwise(cuts if len(portion) else []):
                words = lists.slice(lo, hi - lo).flatten()
                words = pc.dictionary_encode(words.filter(pc.not_equal(words, "")))  # an empty text is one empty word
                at, many = np.repeat(np.arange(hi - lo), lengths[lo:hi]), max(1, len(words.dictionary))
                key, tf = np.unique(at * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at = key // many
                told = [words.dictionary.take(pa.array(key % many)), b.column("id").slice(lo, hi - lo).take(pa.array(at)), pa.array(tf, pa.int64()), pa.array(lengths[lo:hi][at], pa.int32())]
                yield pa.RecordBatch.from_arrays(told, schema.names)

    return rows.mapInArrow(run, schema)


def _lists(cuts: np.ndarray, values: pa.Array | np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values if kind is None else pa.array(values, kind))


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a stretch of equal rows begins."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_], axis=0)])) if len(sorted_[0]) else np.zeros(0, np.int64)


def _packed(postings: DataFrame, groups: int) -> DataFrame:
    """(g, terms, n, ids, tf, length, h): of the postings that a task has at once those of a group of terms in one row, in the
    order of the terms, of which each has n."""
    rows = postings.select("term", "id", F.col("tf").cast("int").alias("tf"), "length", F.pmod(F.hash("term"), F.lit(groups)).alias("g"), F.xxhash64("id").alias("h"))
    many = lambda c, kind: T.StructField(c, T.ArrayType(kind))
    number = T.IntegerType()
    schema = T.StructType([T.StructField("g", number), many("terms", T.StringType()), many("n", number), many("ids", postings.schema["id"].dataType), many("tf", number), many("length", number), many("h", T.LongType())])

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        of = lambda c: t.column(c).to_numpy()
        terms = pc.dictionary_encode(pa.concat_arrays(t.column("term").chunks))
        code, g = terms.indices.to_numpy(zero_copy_only=False), of("g")
        order = np.lexsort((code, g))
        code, g = code[order], g[order]
        first = _starts(code)
        at = _starts(g[first])
        by_term, by_posting = np.append(at, len(first)), np.append(first[at], len(code))
        told = [pa.array(g[first][at], pa.int32()), _lists(by_term, terms.dictionary.take(pa.array(code[first]))), _lists(by_term, np.diff(np.append(first, len(code))), pa.int32())]
        told += [_lists(by_posting, pa.concat_arrays(t.column("id").chunks).take(pa.array(order)))]
        told += [_lists(by_posting, of(c)[order], kind) for c, kind in (("tf", pa.int32()), ("length", pa.int32()), ("h", pa.int64()))]
        return pa.RecordBatch.from_arrays(told, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACK:
                yield packs(held)
                held, n = [], 0
        if held:
            yield packs(held)

    return rows.mapInArrow(run, schema)


def _blocks(postings: DataFrame, many: int) -> DataFrame:
    """Blocks of postings (term, id, tf, length), of which there are about so many."""
    own, block_size = postings.schema["id"].dataType, BLOCK
    one = T.StructType([T.StructField("id", own), T.StructField("tf", T.LongType()), T.StructField("length", T.IntegerType())])
    kinds = {"term": T.StringType(), "block": T.LongType(), "parts": T.LongType(), "n": T.LongType(), "most": T.LongType(), "least": T.IntegerType(), "postings": T.ArrayType(one), "bucket": T.IntegerType()}

    def made(t: pa.Table) -> pa.Table:
        flat = lambda c: pa.concat_arrays(t.column(c).chunks).flatten()
        terms, (tf, length, h) = pc.dictionary_encode(flat("terms")), (flat(c).to_numpy(zero_copy_only=False) for c in ("tf", "length", "h"))
        code = np.repeat(terms.indices.to_numpy(zero_copy_only=False), flat("n").to_numpy(zero_copy_only=False))
        parts = -(-np.bincount(code, minlength=len(terms.dictionary)) // block_size)
        block = h % parts[code]  # that of ``block_of``
        order = np.lexsort((block, code))
        code, block, tf, length = code[order], block[order], tf[order].astype(np.int64), length[order]
        first = _starts(code, block)
        ends = np.append(first, len(code))
        rows = pa.StructArray.from_arrays([flat("ids").take(pa.array(order)), pa.array(tf), pa.array(length)], ["id", "tf", "length"])
        bucket = np.full(len(first), t.column("g")[0].as_py() % BUCKETS, np.int32)
        told = [terms.dictionary.take(pa.array(code[first])), block[first], parts[code[first]], np.diff(ends), np.maximum.reduceat(tf, first), np.minimum.reduceat(length, first), _lists(ends, rows), bucket]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in told], list(kinds))

    groups = BUCKETS * max(1, -(-many // (BUCKETS * PACK)))
    return _packed(postings, groups).groupBy("g").applyInArrow(made, T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))


def _about(docs: DataFrame) -> int:
    """How many postings texts have at most, or nearly: one for six bytes."""
    return (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6


def build(docs: DataFrame) -> TextIndex:
    """The index of (id, text). Ids are unique; null and empty texts are documents without terms."""
    return TextIndex(_blocks(_postings(docs), _about(docs)), _documents(docs))


def changes(index: TextIndex, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts to read, ids to forget) that lead from an index to the texts (id, text) that hold now: a text is read if it is
    new or its content key is another, forgotten if it is gone or read again."""
    now = docs.withColumn("now", F.sha2(F.coalesce("text", F.lit("")), 256))
    old = index.documents.select("id", F.col("key").alias("now"))
    due = now.join(old, ["id", "now"], "left_anti").select("id", "text")
    gone = old.join(now.select("id", "now"), ["id", "now"], "left_anti").select("id")
    return due, gone


def update(index: TextIndex, docs: DataFrame) -> TextIndex:
    """The index of the texts that hold now; only what ``changes`` says is read, other postings are moved at most."""
    due, gone = changes(index, docs)
    due, gone = keep(due, "due"), keep(gone, "gone")
    old = index.blocks.select("term", F.explode("postings").alias("p")).select("term", "p.id", "p.tf", "p.length").join(gone, "id", "left_anti")
    postings = old.select("term", "id", "tf", "length").unionByName(_postings(due))
    many = (index.blocks.agg(F.sum("n")).first()[0] or 0) + _about(due)
    documents = index.documents.join(gone, "id", "left_anti").unionByName(_documents(due))
    return TextIndex(_blocks(postings, many), documents)


def _weight(tf: Column, length: Column) -> Column:
    """What a posting adds but for the term's rarity; grows with the count, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("average")))


def search(index: TextIndex, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, id, bm25, fts_rank) of (query_id, query), as ``recall.bm25``."""
    q = queries.select("query_id", F.explode(F.array_distinct(X.query_terms("query"))).alias("term"))
    wanted = q.select("term", bucket_of(F.col("term")).alias("bucket")).distinct()
    blocks = index.blocks.join(wanted, ["bucket", "term"], "left_semi")  # other buckets' files are not read
    stats = index.documents.agg(F.count("*").alias("docs"), F.avg("length").alias("average"))  # one row
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    known = blocks.crossJoin(F.broadcast(stats)).groupBy("bucket", "term", "docs", "average").agg(F.sum("n").alias("df"), F.first("parts").alias("parts"), F.max(_weight(F.col("most"), F.col("least"))).alias("bound"))
    known = known.withColumn("idf", idf).withColumn("bound", F.col("idf") * F.col("bound"))
    plan = keep(q.join(known, "term"), "plan")  # (query_id, term, df, parts, idf, bound): the words of the queries

    # a threshold: the last place of the pool among the documents of a query's heaviest terms
    heavy = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    before = F.coalesce(F.sum("df").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = plan.withColumn("before", before).where(F.col("before") < 4 * pool).drop("before")
    opened = lambda terms, b=blocks: terms.join(b.select("term", F.explode("postings").alias("p")), "term").select("query_id", "term", "p.id", (F.col("idf") * _weight(F.col("p.tf"), F.col("p.length"))).alias("w"))
    partial = opened(some).groupBy("query_id", "id").agg(F.sum("w").alias("s"))
    place = Window.partitionBy("query_id").orderBy(F.desc("s"))
    least = partial.withColumn("k", F.row_number().over(place)).where(F.col("k") == pool).select("query_id", (F.col("s") - SLACK).alias("least"))

    # terms that together stay under it bring no document of their own
    light = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = keep(plan.join(least, "query_id", "left").withColumn("own", F.coalesce(F.sum("bound").over(light) >= F.col("least"), F.lit(True))).drop("least"), "split")
    brought = keep(opened(split.where("own")), "brought")
    candidates = brought.select("query_id", "id").distinct()
    asked = candidates.join(split.where("not own"), "query_id").withColumn("block", block_of(F.col("id"), F.col("parts")))
    cell = blocks.select("term", "block", F.explode("postings").alias("p")).select("term", "block", "p.id", "p.tf", "p.length")
    more = asked.join(cell.join(asked.select("term", "block").distinct(), ["term", "block"], "left_semi"), ["term", "block", "id"])
    scored = brought.unionByName(more.select("query_id", "term", "id", (F.col("idf") * _weight(F.col("tf"), F.col("length"))).alias("w")))
    summed = scored.groupBy("query_id", "id").agg(F.round(-F.sum("w"), 6).alias("bm25"))
    w = Window.partitionBy("query_id").orderBy("bm25", "id")
    return summed.withColumn("fts_rank", F.row_number().over(w)).where(F.col("fts_rank") <= pool)
