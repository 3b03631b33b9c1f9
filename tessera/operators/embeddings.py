"""Embeddings as a table that follows its texts: only what is new or has changed is sent to a provider."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Provider = Callable[[list[str]], list[list[float]]]
BATCH, TRIES, PAUSE_S = 64, 3, 0.5


def keyed(inputs: DataFrame, model: str, width: int, key: Column | None = None) -> DataFrame:
    """(id, text, model, dimensions, content_key) of (id, text); the key is the text's digest unless another is given."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256) if key is None else key
    return inputs.withColumns({"model": F.lit(model), "dimensions": F.lit(width), "content_key": content})


def asked(texts: list[str], provider: Provider, width: int, tries: int = TRIES, pause_s: float = PAUSE_S) -> list[list[float]]:
    """What a provider answers for some texts. A call that fails, or an answer of another number or width, is tried again
    after a pause that doubles; the last failure is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            got = provider(texts)
            if len(got) != len(texts) or any(len(v) != width for v in got):
                raise ValueError(f"expected {len(texts)} vectors of {width} numbers")
            return got
        except Exception:
            if not left:
                raise
            time.sleep(pause_s)
            pause_s *= 2
    raise ValueError("no try was allowed")


def embedded(due: DataFrame, provider: Provider, width: int, batch: int = BATCH) -> DataFrame:
    """Adds ``embedding`` to rows with a text. The provider runs on the executors, for so many texts at a time; a batch that
    fails for good fails its task, which Spark repeats elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                vectors = asked([t or "" for t in b.column("text").to_pylist()], provider, width)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return due.mapInArrow(run, T.StructType([*due.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def refreshed(stored: DataFrame, inputs: DataFrame, provider: Provider, model: str, width: int, batch: int = BATCH, key: Column | None = None) -> DataFrame:
    """The table (id, model, dimensions, content_key, embedding) that holds for the texts (id, text) of now: rows of other
    models stay, rows of this one whose text is the same stay, those whose text is gone go, and only the others are
    embedded. Ids are unique among the inputs; a null text is the empty one."""
    names = ["id", "model", "dimensions", "content_key", "embedding"]
    now, at = keyed(inputs, model, width, key), ["id", "model", "dimensions", "content_key"]
    mine = F.col("model") == model
    same = stored.where(mine).join(now.select(at), at, "left_semi")
    due = now.join(stored.select(at), at, "left_anti")
    return stored.where(~mine).select(names).unionByName(same.select(names)).unionByName(embedded(due, provider, width, batch).select(names))
