"""Vector search in blocks: exact over all vectors, or through an inverted file that is a stored table.

Vectors lie packed, so many to a row; queries are packed alike, and a block and a group of queries meet in one row, whose
scores are one matrix product. A block answers with its best k, and the answers of all blocks meet by query. Packed rows are
larger than a plan can know, so the joins are told to shuffle them. Nothing is broadcast but the centroids of an inverted file, whose number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.sources.scratch import keep

BLOCK, GROUP = 2048, 2048
STRIP = 256  # queries of a group that are scored at once
SAMPLE = 20_000  # vectors that the cells are fitted on, at most
MOST_CELLS = 4096
BATCH_BYTES, BATCH_BITS = "spark.sql.execution.arrow.maxBytesPerBatch", 22
SLICE = 512  # vectors that are repeated for their cells at once


def bound_batches(spark: SparkSession) -> None:
    """Packed rows of a megabyte or two go to Python a few at a time: a batch is bounded by bytes, not only by rows, unless
    the session asks for less."""
    now = spark.conf.get(BATCH_BYTES, None)
    if now is None or not now.isdigit() or int(now) > 1 << BATCH_BITS:
        spark.conf.set(BATCH_BYTES, str(1 << BATCH_BITS))


def finite(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, width): vectors of unit length (zero vectors stay), in double; null vectors and those with a null or
    non-finite number drop out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = rows.where(F.col(vector_col).isNotNull() & ~bad)
    unit = V.l2_normalise(F.transform(vector_col, lambda x: x.cast("double")))
    return some.select(F.col(id_col).alias("id"), unit.alias("v"), F.size(vector_col).alias("width"))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids, data): the rows (id, v, ...) of each key in one, vectors side by side."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("data", T.BinaryType())])

    def pack(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids = t.column("id").combine_chunks()
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "data": pa.array([v.tobytes()], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(pack, schema)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each pair (ids, data, asked, wanted) of a block and a group of queries, each query's best k."""
    query, own = pairs.schema["asked"].dataType.elementType, pairs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", query), T.StructField("id", own), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, asked = b.column("ids")[i].as_py(), b.column("asked")[i].as_py()
                v = np.frombuffer(b.column("data")[i].as_py(), np.float64).reshape(len(ids), -1)
                q = np.frombuffer(b.column("wanted")[i].as_py(), np.float64).reshape(len(asked), -1)
                rows = []
                for j, s in enumerate(s for at in range(0, len(q), STRIP) for s in np.round(q[at : at + STRIP] @ v.T, 6) + 0.0):
                    near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    rows += [(asked[j], x, c) for c, x in sorted(((float(s[n]), ids[n]) for n in near), key=lambda y: (-y[0], y[1]))[:k]]
                told, names = list(zip(*rows, strict=True)), ["query_id", "id", "score"]
                kinds = [b.schema.field("asked").type.value_type, b.schema.field("ids").type.value_type, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(told, kinds, strict=True)], names)

    return pairs.mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("vector_rank", F.row_number().over(w)).where(F.col("vector_rank") <= k)


def _parts(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, vector_rank): exact cosine top k of (id, embedding) for (query_id, query_vector), a stated query
    set that meets all rows in blocks. Vectors that are not finite or of another width drop out; ties go to the smaller
    id."""
    bound_batches(vectors.sparkSession)
    d, q = finite(vectors, "id", "embedding"), finite(queries, "query_id", "query_vector")
    n, m = _parts(vectors, BLOCK), _parts(queries, GROUP)
    blocks = _packed(d.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), ["block", "width"])
    groups = _packed(q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")), ["part", "width"]).withColumnsRenamed({"ids": "asked", "data": "wanted"})
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).join(groups.hint("merge"), ["block", "part", "width"])
    return _ranked(_best(pairs, k), k)


@dataclass(frozen=True)
class VectorIndex:
    """blocks: cell, width, salt, ids, data (every vector is in one); centroids: cell, centroid."""

    blocks: DataFrame
    centroids: DataFrame

    def write(self, folder: str) -> None:
        """The blocks lie by cell, so a search reads the cells that it probes."""
        self.blocks.repartition("cell").write.partitionBy("cell").parquet(f"{folder}/blocks")
        self.centroids.write.parquet(f"{folder}/centroids")


def read(spark: SparkSession, folder: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/centroids"))


def _cells(rows: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """Rows with their n nearest cells, one row each; of vectors of another width than the centroids, cell -1."""
    held = [(r["cell"], r["centroid"]) for r in centroids.orderBy("cell").collect()]  # at most MOST_CELLS
    if not held:
        return rows.withColumn("cell", F.lit(-1))
    numbers, table = np.array([c for c, _ in held], np.int32), np.array([v for _, v in held])
    shared = rows.sparkSession.sparkContext.broadcast((numbers, table))
    n = min(n, len(held))
    same = rows.where(F.col("width") == table.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table = shared.value
        for whole in batches:
            for b in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near = np.argsort(-(v @ table.T), axis=1, kind="stable")[:, :n]
                b = b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers[near].ravel())], [*b.schema.names, "cell"])

    near = same.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    return near.unionByName(rows.where(F.col("width") != table.shape[1]).withColumn("cell", F.lit(-1)))


def build(vectors: DataFrame, cells: int = 32, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    """The index of (id, embedding). The cells are fitted on at most ``sample`` vectors, chosen by hash of their id, of the
    commonest width among them; every vector is put into its nearest cell. Few or no vectors: fewer or no cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells")
    bound_batches(vectors.sparkSession)
    d = finite(vectors, "id", "embedding")
    some = keep(d.orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    width = some.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).select("width").collect()
    zero = F.exists("v", lambda x: x != 0)
    points = some.where(F.col("width") == (width[0]["width"] if width else -1)).where(zero)
    rows = []
    if points.head(1):
        model = KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine").fit(points.select(array_to_vector("v").alias("features")))
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")
    placed = keep(_cells(d, centroids, 1), "placed")
    size = placed.groupBy("cell", "width").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    salted = placed.join(size, ["cell", "width"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    return VectorIndex(_packed(salted, ["cell", "width", "salt"]), centroids)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """(query_id, id, score, vector_rank) of (query_id, query_vector): the exact best k among the vectors of each query's
    nearest cells. Scores and ties are those of ``exact``, which it equals when all cells are probed. Vectors of another
    width than the cells' are all compared with queries of that width."""
    bound_batches(queries.sparkSession)
    q = _cells(finite(queries, "query_id", "query_vector"), index.centroids, probes)
    m = F.pmod(F.xxhash64("id"), F.lit(_parts(queries, GROUP))).cast("int")
    groups = _packed(q.withColumn("part", m), ["cell", "width", "part"]).withColumnsRenamed({"ids": "asked", "data": "wanted"})
    return _ranked(_best(index.blocks.join(groups.hint("merge"), ["cell", "width"]).drop("salt"), k), k)
