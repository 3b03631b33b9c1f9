"""Another store's tables as Spark relations: a data source that reads records in parts, from files or over HTTP.

``spark.read.format("tessera_records")`` takes a schema and either ``folder``, whose files of JSON lines are cut into parts of
``STRETCH`` bytes (compressed ones are a part each), or
``url``, ``table``, ``token`` and ``parts``: a service that gives the records of one part of a table at a time. Each part is a
task of its own; no row and no answer holds a whole table. A record that is no object of the schema is an error.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.operators.replication import TABLES

NAME = "tessera_records"
BATCH, TIMEOUT_S, TRIES = 4096, 60, 3
STRETCH = 32 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".br", ".snappy")


class Part(InputPartition):
    """A file, the lines of it that begin from one byte up to another, or a part of a remote table."""

    def __init__(self, place: str, lo: int = 0, hi: int | None = None) -> None:
        self.place, self.lo, self.hi = place, lo, hi


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        if self.options.get("table") in TABLES:
            return TABLES[self.options["table"]].schema
        raise ValueError("a schema is needed")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(schema, dict(self.options))


class RecordReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.kinds, self.options = to_arrow_schema(schema), options

    def partitions(self) -> list[Part]:
        if "folder" in self.options:
            files, path = fs.FileSystem.from_uri(_uri(self.options["folder"]))
            scheme = _uri(self.options["folder"]).split(path)[0]
            found = files.get_file_info(fs.FileSelector(path))
            some = sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
            cuts = lambda f: [(0, None)] if f.path.endswith(COMPRESSED) else [(lo, lo + STRETCH) for lo in range(0, f.size, STRETCH)]
            return [Part(scheme + f.path, *cut) for f in some for cut in cuts(f)] or [Part("")]
        n = int(self.options.get("parts", 4))
        return [Part(f"{self.options['url'].rstrip('/')}/v1/records/{self.options['table']}?part={i}&of={n}") for i in range(n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        records = _lines(partition.place, partition.lo, partition.hi) if "folder" in self.options else _asked(partition.place, self.options.get("token"))
        rows: list[dict] = []
        for r in records:
            if not isinstance(r, dict):
                raise ValueError(f"not a record: {str(r)[:80]}")
            rows.append(r)
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.kinds], schema=self.kinds)


def _uri(folder: str) -> str:
    return folder if ":/" in folder else "file://" + folder


def _lines(place: str, lo: int = 0, hi: int | None = None) -> Iterator[dict]:
    """The records of the lines that begin at a byte from ``lo`` and before ``hi``; without ``hi`` of the whole file."""
    if place:
        files, path = fs.FileSystem.from_uri(place)
        with files.open_input_stream(path, compression="detect") if hi is None else files.open_input_file(path) as f:
            at = max(lo - 1, 0)
            if at:
                f.seek(at)
            rest, before = b"", lo > 0  # what ends first began before this part
            while chunk := f.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                for x in whole:
                    begins, at = at, at + len(x) + 1
                    if before:
                        before = False
                    elif hi is not None and begins >= hi:
                        return
                    elif x.strip():
                        yield json.loads(x)
            if rest.strip() and not before and (hi is None or at < hi):
                yield json.loads(rest)


def _asked(url: str, token: str | None, send: Callable = urllib.request.urlopen) -> Iterator[dict]:
    """The records of a part; a request that breaks off is made again."""
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    for left in range(TRIES - 1, -1, -1):
        try:
            with send(request, timeout=TIMEOUT_S) as r:
                doc = json.loads(r.read())
            break
        except (OSError, json.JSONDecodeError) as e:
            if isinstance(e, urllib.error.HTTPError) or not left:  # a refusal stays one
                raise
    yield from doc["records"]


def records(spark: SparkSession, schema: str | StructType, **options) -> DataFrame:
    """The relation that some options of the data source stand for."""
    spark.dataSource.register(RecordSource)
    return spark.read.format(NAME).schema(schema).options(**{k: str(v) for k, v in options.items() if v is not None}).load()


class RemoteStore:
    """A store elsewhere, for what only reads: each table is the relation of its records."""

    def __init__(self, spark: SparkSession, url: str, token: str | None = None, parts: int = 4) -> None:
        self.spark, self.url, self.token, self.parts = spark, url, token, parts

    def read(self, table: str) -> DataFrame:
        return records(self.spark, TABLES[table].schema, url=self.url, table=table, token=self.token, parts=self.parts)
