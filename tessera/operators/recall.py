"""Recall over many queries at once: inverted index with BM25, exact vector search, their blend, evaluation.

Documents lie packed in blocks with their terms and counts; a block and a group of queries meet in one row, and only each
query's best of a block are moved. Ranks have a total order (score, then id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import vectorindex
from tessera.sources.scratch import keep

# BM25 parameters and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
POOL = 50
BLOCK_TOKENS, GROUP = 1 << 19, 256  # tokens of a block of documents, queries that meet it at once


def tokenised(docs: DataFrame) -> DataFrame:
    """(id, length, all): the tokens of (id, text), split once; a text is not carried further."""
    return docs.select("id", X.tokens("text").alias("all")).select("id", F.size("all").alias("length"), "all")


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, length) of (id, text); with ``terms``, of these only (the rest is dropped before the shuffle)."""
    t = tokenised(docs).select("id", "length", F.explode("all").alias("term"))
    if terms is not None:
        t = t.join(terms, "term", "left_semi")
    return t.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def packed(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents (id, text), cut where ``BLOCK_TOKENS`` are reached: ids, lengths, terms (of the block), n (how
    many of its documents have each), and the postings in the order of the terms, as numbers: at (place of the document), tf.
    A document's counts are told where it is read, so no posting is moved."""
    rows = docs.select("id", X.joined_tokens("text").alias("all"))
    many, number, bytes_ = (T.ArrayType(x) for x in (docs.schema["id"].dataType, T.IntegerType(), T.StringType()))
    schema = T.StructType([T.StructField(c, kind) for c, kind in (("ids", many), ("lengths", number), ("terms", bytes_), ("n", number), ("at", T.BinaryType()), ("tf", T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern(b.column("all"), " ")
            lengths = np.where(pc.binary_length(b.column("all")).to_numpy(zero_copy_only=False) > 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
            block = np.cumsum(lengths, dtype=np.int64) // BLOCK_TOKENS
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for lo, hi in pairwise(cuts if len(block) else []):
                words = lists.slice(lo, hi - lo).flatten()
                words = pc.dictionary_encode(words.filter(pc.not_equal(words, "")))  # an empty text is one empty word
                at = np.repeat(np.arange(hi - lo), lengths[lo:hi])
                key, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (hi - lo) + at, return_counts=True)
                n = np.bincount(key // (hi - lo), minlength=len(words.dictionary))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                raw = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (key % (hi - lo), tf)]
                told = [one(x) for x in (b.column("id").slice(lo, hi - lo), pa.array(lengths[lo:hi], pa.int32()), words.dictionary, pa.array(n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*told, *raw], schema.names)

    return rows.mapInArrow(run, schema)


def _scored(pairs: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, bm25): of each pair of a block and a group of queries (``asked``: query_id, term, idf; average), each
    query's best ``pool``."""
    query, own = pairs.schema["asked"].dataType.elementType["query_id"].dataType, pairs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", query), T.StructField("id", own), T.StructField("bm25", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                of = lambda c: b.column(c)[i].values  # noqa: B023, E731
                n, lengths = of("n").to_numpy(zero_copy_only=False), of("lengths").to_numpy(zero_copy_only=False)
                at, tf = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in ("at", "tf"))
                ends, rest = np.cumsum(n), K1 * (1 - B + B * lengths / b.column("average")[i].as_py())
                asked = of("asked")
                terms, queries = (pc.dictionary_encode(asked.field(c)) for c in ("term", "query_id"))
                place = pc.index_in(terms.dictionary, of("terms")).fill_null(-1).to_numpy(zero_copy_only=False)
                code, who = (x.indices.to_numpy(zero_copy_only=False) for x in (terms, queries))
                idf, order = asked.field("idf").to_numpy(zero_copy_only=False), np.argsort(code, kind="stable")
                bounds = np.searchsorted(code[order], np.arange(len(place) + 1))
                score = np.zeros((len(queries.dictionary), len(lengths)))
                for t in np.flatnonzero(place >= 0):
                    lo, hi, mine = ends[place[t]] - n[place[t]], ends[place[t]], order[bounds[t] : bounds[t + 1]]
                    docs, k = at[lo:hi], tf[lo:hi]
                    score[who[mine][:, None], docs] += idf[mine][:, None] * (k * (K1 + 1) / (k + rest[docs]))
                by_id = np.empty(len(lengths), np.int64)
                by_id[pc.sort_indices(of("ids")).to_numpy(zero_copy_only=False)] = np.arange(len(lengths))
                names, found, values = [], [], []
                for k, s in enumerate(score):
                    hit = np.flatnonzero(s > 0)
                    r = np.round(-s[hit], 6)
                    if len(hit) > pool:
                        near = np.flatnonzero(r <= np.partition(r, pool - 1)[pool - 1])
                        near = near[np.lexsort((by_id[hit[near]], r[near]))[:pool]]
                        hit, r = hit[near], r[near]
                    names.append(np.full(len(hit), k)), found.append(hit), values.append(r)
                take = lambda values, where: values.take(pa.array(np.concatenate(where).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([take(queries.dictionary, names), take(of("ids"), found), pa.array(np.concatenate(values))], schema.names)

    return pairs.mapInArrow(run, schema)


def bm25(docs: DataFrame, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, id, bm25, fts_rank): the best ``pool`` documents of each query; lower (more negative) is better, as
    full-text indexes count. (id, text) x (query_id, query).

    Queries share their usual words, so a join of terms makes a row for most pairs of a query and a document. Blocks of
    documents meet groups of queries instead, and a block answers with the best of each query. Texts are read once."""
    vectorindex.bound_batches(docs.sparkSession)
    q = queries.select("query_id", F.explode(F.array_distinct(X.query_terms("query"))).alias("term"))
    blocks = keep(packed(docs), "blocks", large=True)
    terms = blocks.select(F.explode(F.arrays_zip("terms", "n")).alias("t")).select(F.col("t.terms").alias("term"), "t.n")
    df = terms.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x)
    stats = blocks.agg(F.sum(F.size("ids")).alias("n"), (F.sum(total) / F.sum(F.size("ids"))).alias("average"))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    parts = max(1, -(-queries.count() // GROUP))
    asked = q.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    groups = asked.groupBy("part", "average").agg(F.collect_list(F.struct("query_id", "term", idf.alias("idf"))).alias("asked"))
    found = _scored(blocks.crossJoin(groups.drop("part")), pool)
    w = Window.partitionBy("query_id").orderBy("bm25", "id")
    return found.select("query_id", "id", F.round("bm25", 6).alias("bm25")).withColumn("fts_rank", F.row_number().over(w)).where(F.col("fts_rank") <= pool)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """(query_id, id, score, vector_rank): exact cosine top k of (id, embedding) for (query_id, query_vector), in blocks of
    both; see ``vectorindex`` for the rules and for a way that does not look at every vector."""
    return vectorindex.exact(vectors, queries, k)


def blend(docs: DataFrame, queries: DataFrame, fts: DataFrame, vector: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): 10 a term point, 1 / (1 + |bm25|), 1 / vector rank; newest first on ties."""
    fts = keep(fts, "fts")
    hits = fts.select("query_id", "id", "bm25", F.lit(None).cast("int").alias("vector_rank"))
    if vector is not None:
        hits = hits.unionByName(vector.select("query_id", "id", F.lit(None).cast("double").alias("bm25"), "vector_rank"))
    merged = hits.groupBy("query_id", "id").agg(F.min("bm25").alias("bm25"), F.min("vector_rank").alias("vector_rank"))
    # so many texts as a query's pool has, not all, are moved
    some = docs.select("id", "text", "created_at_ms").join(F.broadcast(merged.select("id").distinct()), "id", "left_semi")
    rows = merged.join(queries, "query_id").join(some, "id")
    from_text = F.when(F.col("bm25").isNotNull(), X.recall_score("text", X.query_terms("query"), F.col("query"))).otherwise(0)
    score = 10.0 * from_text + F.coalesce(1 / (1 + F.abs("bm25")), F.lit(0.0)) + F.coalesce(1 / F.col("vector_rank"), F.lit(0.0))
    scored = rows.select("query_id", "id", "created_at_ms", F.round(score, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at_ms"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("created_at_ms")


def vector_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Vector hits (query_id, id, score, vector_rank) with the attributes of their files (id, path, language); a hit without
    a file stays."""
    return hits.join(files, "id", "left")


def scopes(project: DataFrame, other: DataFrame, n_project: int = 5, n_other: int = 3) -> DataFrame:
    """Ranked facts (query_id, id, score, rank) of the project, then of the global scope those that are not there yet."""
    p = project.where(F.col("rank") <= n_project)
    g = other.where(F.col("rank") <= n_other).join(p.select("query_id", "id"), ["query_id", "id"], "left_anti")
    pick = lambda d, name: d.select("query_id", "id", "score", F.lit(name).alias("scope"), "rank")
    return pick(p, "project").unionByName(pick(g, "global"))


def evaluate(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: cases, recall, hit rate and mean reciprocal rank of (query_id, id, rank) against (query_id, id)."""
    want = expected.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hits = ranked.join(expected, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    each = want.join(hits, "query_id", "left").select(F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0)).alias("recall"), F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return each.agg(F.count("*").alias("cases"), mean("recall").alias("recall"), mean("hit").alias("hit_rate"), mean("rr").alias("mrr"))
