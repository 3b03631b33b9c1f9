"""Operator 13, hard-negative mining with a vector-approximation file.

Rows are dealt into blocks. A block quantises each dimension into 256 cells between its own quantiles and keeps the cells of
every row, a byte a dimension, beside the whole vectors. For an anchor the least and the largest that a cell can add to the
score go into tables; two table look-ups a dimension give a lower and an upper bound of every row's score. Only rows whose
bounds could put them among the answers are scored exactly, in integers: about one in fifty of the check tables' rows.

1. Positives: a block answers each anchor with its best rows of the anchor's label. Those whose upper bound is under the
   k-th largest lower bound are not scored. The answers of all blocks meet by anchor, and the best stay.
2. Negatives: each positive of an anchor opens a window of scores. A block answers each window with its best rows of other
   labels in it; rows whose bounds miss every window, or that k rows surely inside a window surpass, are not scored.

Scale: anchors are a stated query set against all rows, in blocks: groups of anchors meet blocks of rows, each pair of them
in one task's call, and memory holds one block and one group. Nothing is broadcast; what blocks return is at most k rows a
window, kept to the best by Spark before the shuffle by anchor. Rows are dealt by hash of their id, so no label, however
common, makes a block larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, discard, save, table

BLOCK_ROWS, GROUP_ANCHORS = 4096, 2048
CELLS = 256
MOST, MOST_SCORE = float(1 << 62), 2**63 - 1  # beyond these a component, a score counts as that


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v): rows with an id, a label and a vector of finite components, each component x as floor(scale x)."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    plain = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    return plain.withColumn("v", F.transform("v", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * scale).cast("double"))).cast("long")))


def _deal(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """(name, blob): the rows of each part in one row, by id. Of rows that share their id the first by label and vector
    stays."""

    def pack(t: pa.Table) -> pa.Table:
        label, vectors = t.column("label").to_numpy(), t.column("v").combine_chunks()
        size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().to_numpy().astype(np.int64)
        whole = np.zeros((len(size), int(size.max(initial=0))), np.int64)
        whole[np.arange(whole.shape[1]) < size[:, None]] = flat  # short vectors end in zeros
        ids = t.column("id").to_numpy()
        order = np.lexsort((*whole.T[::-1], label, ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        part = [ids[order], label[order], whole[order].ravel()]
        return pa.table({name: pa.array([t.column(name)[0].as_py()], pa.int32()), "blob": pa.array([np.concatenate([[len(order), whole.shape[1]], *part]).tobytes()], pa.binary())})

    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    return rows.withColumn(name, part).groupBy(name).applyInArrow(pack, f"{name} int, blob binary")


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a part."""
    a = np.frombuffer(blob, np.int64)
    n, d = int(a[0]), int(a[1])
    return a[2 : 2 + n], a[2 + n : 2 + 2 * n], a[2 + 2 * n :].reshape(n, d)


class Approximation:
    """The cells of a block's rows, and bounds of their scores with an anchor."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, d = vectors.shape
        self.vectors = vectors
        self.low, self.high, self.codes = np.zeros((d, CELLS)), np.zeros((d, CELLS)), np.zeros((d, n), np.intp)
        for k in range(d):
            x = vectors[:, k]
            self.codes[k] = np.searchsorted(np.quantile(x, np.arange(1, CELLS) / CELLS), x, "right")
            order = np.argsort(self.codes[k], kind="stable")
            cells, first = np.unique(self.codes[k][order], return_index=True)  # of the values that a cell really has
            self.low[k, cells], self.high[k, cells] = np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)

    def bounds(self, anchor: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the anchor's scores with the rows, by look-ups."""
        q = np.zeros((len(self.low), 1))
        m = min(len(anchor), len(q))
        q[:m, 0] = anchor[:m]
        a, b = self.low * q, self.high * q
        most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) * len(q)
        slack = 1e-9 * most if most > 2**50 else 0.0  # sums beyond 2^53 are rounded
        kind = np.complex64 if most < 2**24 else np.complex128  # both bounds in one look-up, both exact
        tables = (np.minimum(a, b) + 1j * np.maximum(a, b)).astype(kind)
        both = np.zeros(len(self.vectors[rows]), kind)
        for t, c in zip(tables, self.codes, strict=True):
            both += t.take(c[rows], mode="clip")
        lower, upper = both.real, both.imag
        return np.clip(lower.astype(float) - slack, -(2.0**63), 2.0**63 - 2048), np.clip(upper.astype(float) + slack, 2048 - 2.0**63, 2.0**63)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The exact integer scores of some rows."""
        m = min(len(anchor), self.vectors.shape[1])
        v, q = self.vectors[rows, :m], anchor[:m]
        if float(np.abs(v.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * m < 2**62:
            return v @ q
        exact = v.astype(object) @ q.astype(object)
        return np.array([max(-MOST_SCORE, min(MOST_SCORE, x)) for x in exact], np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, or less than anything."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def nearest_alike(block: tuple, anchors: tuple, k: int):
    """(anchor, id, score): for each anchor the block's k best rows of its label, other than itself."""
    ids, labels, vectors = block
    file = Approximation(vectors)
    of = {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}
    for a, label, v in zip(*anchors, strict=True):
        rows = of.get(int(label), np.zeros(0, np.int64))
        rows = rows[ids[rows] != a]
        if len(rows):
            lower, upper = file.bounds(v, rows)
            rows = rows[upper >= _kth(lower, k)]
            score = file.scores(v, rows)
            for i in _best(score, ids[rows], k).tolist():
                yield int(a), int(ids[rows[i]]), int(score[i])


def within_windows(block: tuple, anchors: tuple, windows: dict[int, list[tuple[int, int]]], k: int, least: int, most: int):
    """(anchor, positive, positive's score, id, score): for each positive (id, score) of an anchor the block's k best rows
    of other labels with least * score <= 100 * s <= most * score."""
    ids, labels, vectors = block
    file = Approximation(vectors)
    for a, label, v in zip(*anchors, strict=True):
        # no score is inside a window whose upper end is below its lower one
        own = [(p, s, -(-least * s // 100), most * s // 100) for p, s in windows.get(int(a), []) if least * s <= most * s]
        if not own:
            continue
        lower, upper = file.bounds(v)
        other = labels != label
        need = np.zeros(len(ids), bool)
        for lo, hi in {(lo, hi) for _, _, lo, hi in own}:
            sure = other & (lower >= lo) & (upper <= hi)
            need |= other & (upper >= max(lo, _kth(lower[sure], k))) & (lower <= hi)
        rows = np.flatnonzero(need)
        score = file.scores(v, rows)
        for p, s, lo, hi in own:
            inside = np.flatnonzero((score >= lo) & (score <= hi))
            for i in inside[_best(score[inside], ids[rows[inside]], k)].tolist():
                yield int(a), p, s, int(ids[rows[i]]), int(score[i])


def _answers(pairs: DataFrame, answer, schema: str) -> DataFrame:
    """What ``answer(block, anchors, more)`` yields for every pair of a block and a group of anchors."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            more = b.column("windows").to_pylist() if "windows" in b.schema.names else [None] * b.num_rows
            for k in range(b.num_rows):
                out = list(answer(_opened(b.column("blob")[k].as_py()), _opened(b.column("anchors")[k].as_py()), more[k]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return pairs.mapInArrow(run, schema)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95, block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``rows`` and ``anchors`` are (id, label,
    v) as ``usable`` makes them, anchors some of the rows.

    An anchor's positives are its best other rows of the same label; a positive's negatives are the anchor's best rows of
    other labels whose score is between least and most hundredths of the positive's. Scores are integer inner products over
    the dimensions that both vectors have; ties go to the smaller id. Rows without a place in the query (see ``usable``)
    never appear; of rows that share an id the first by label and vector stays; what does not fit a long counts as the
    nearest that does. Vectors may differ in length. No row, no anchor, or no positive with a negative: no rows.
    """
    bound_batches(rows.sparkSession)
    n, m = rows.count(), anchors.count()
    n_blocks, n_groups = max(1, -(-n // block_rows)), max(1, -(-m // group_anchors))
    blocks = save(_deal(rows, n_blocks, "block"), "blocks")
    groups = save(_deal(anchors, n_groups, "part").withColumnRenamed("blob", "anchors"), "anchors")
    spread = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    every = lambda g: g.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    pairs = spread.join(every(groups).hint("shuffle_hash"), ["block", "part"]).drop("part")
    alike = _answers(pairs, lambda b, a, _: nearest_alike(b, a, n_positives), "anchor long, id long, score long")
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    positives = save(alike.withColumn("rank", first(["anchor"])).where(F.col("rank") <= n_positives).drop("rank"), "positives")

    part = F.pmod(F.xxhash64("anchor"), F.lit(n_groups)).cast("int")
    windows = positives.groupBy(part.alias("part")).agg(F.collect_list(F.struct("anchor", "id", "score")).alias("windows"))  # of a group of anchors
    pairs = spread.join(every(groups.join(windows, "part")).hint("shuffle_hash"), ["block", "part"]).drop("part")

    def inside(block, anchors, windows):
        by: dict[int, list[tuple[int, int]]] = {}
        for w in windows:
            by.setdefault(w["anchor"], []).append((w["id"], w["score"]))
        return within_windows(block, anchors, by, n_negatives, least, most)

    found = _answers(pairs, inside, "anchor long, positive long, positive_score long, id long, score long")
    found = found.withColumn("rank", first(["anchor", "positive"])).where(F.col("rank") <= n_negatives)
    out = save(found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(blocks, groups, positives)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth row; every seventh row's label is the next one."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("id") % 50 == 0))


SQL = """
WITH u AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM u WHERE id % 50 = 0),
s AS (SELECT a.id AS anchor, u.id, a.label = u.label AS alike, list_inner_product(a.v, u.v)::BIGINT AS score FROM a JOIN u ON a.id <> u.id),
p AS (SELECT anchor, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
