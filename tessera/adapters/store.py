"""A store of the model's tables in a folder: versioned snapshots of each, with the operators that change them.

A change writes a whole new snapshot beside the old one and then names it in the table's log, so readers see the old
rows or the new ones; what is appended only adds files to a snapshot of its own.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import embeddings, indexing, lifecycle, memory, replication, sessions
from tessera.operators.replication import TABLES
from tessera.sources.scratch import keep

# Fixed order: the steps by which a store came to its tables; each may be repeated.
MIGRATIONS = [
    ("facts", ["memories", "memory_embeddings"]), ("graph", ["sources", "entities", "edges"]), ("projects", ["projects"]), ("files", ["discovered_files"]), ("sessions", ["sessions", "session_events"]),
    ("promotions", ["session_promotions"]), ("packs", ["context_packs"]), ("diagnostics", ["diagnostics"]), ("symbols", ["code_symbols"]), ("references", ["code_references"]), ("tests", ["test_mappings"]), ("vectors", ["source_embeddings"]),
]
PROJECT = "project_local"
AUDIT = {"sync_runs": "id string, operation string, status string, started_at_ms long", "sync_table_runs": "run_id string, table string, inserted long, updated long, skipped long", "sync_table_conflicts": "run_id string, table string, reason string, n long"}


class Conflict(RuntimeError):
    """Another writer has changed a table since it was read."""


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._seen: dict[str, int] = {}  # the version of each table that was read last

    # --- tables
    def _log(self, table: str) -> str:
        return f"{self.folder}/{table}/_log"

    def _schema(self, table: str) -> str:
        return TABLES[table].schema if table in TABLES else AUDIT[table]

    def _version(self, table: str) -> tuple[int, str] | None:
        try:
            rows = self.spark.read.schema("version long, path string").json(self._log(table)).orderBy(F.desc("version")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return (rows[0]["version"], rows[0]["path"]) if rows else None

    def read(self, table: str) -> DataFrame:
        found = self._version(table)
        self._seen[table] = found[0] if found else 0
        return self.spark.read.schema(self._schema(table)).parquet(f"{self.folder}/{table}/{found[1]}") if found else self.spark.createDataFrame([], self._schema(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Makes some rows the whole table. They follow the version that was read last; if another writer has named the next
        one meanwhile, nothing changes and ``Conflict`` is raised."""
        found = self._version(table)
        version = self._seen.get(table, found[0] if found else 0) + 1
        path = lifecycle.new_id("v")
        names = [c.split()[0] for c in self._schema(table).split(", ")]
        rows.select(names).write.parquet(f"{self.folder}/{table}/{path}")
        jvm = self.spark.sparkContext._jvm
        entry = jvm.org.apache.hadoop.fs.Path(f"{self._log(table)}/{version:012d}.json")
        files = entry.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = files.create(entry, False)  # only one writer creates it
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{table} has changed") from e
            raise
        out.write(bytearray(json.dumps({"version": version, "path": path}).encode()))
        out.close()
        self._seen[table] = version

    def append(self, table: str, rows: DataFrame) -> None:
        names = [c.split()[0] for c in self._schema(table).split(", ")]
        found = self._version(table)
        if found:
            rows.select(names).write.mode("append").parquet(f"{self.folder}/{table}/{found[1]}")
        else:
            self.replace(table, rows)

    def migrate(self) -> list[str]:
        """Creates what is missing; the names of the steps that did anything."""
        done = []
        for name, tables in MIGRATIONS:
            new = [t for t in tables if self._version(t) is None]
            for t in new:
                self.replace(t, self.spark.createDataFrame([], self._schema(t)))
            done += [name] if new else []
        return done

    def _rows(self, table: str, *rows: dict) -> DataFrame:
        names = [c.split()[0] for c in self._schema(table).split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], self._schema(table))

    # --- projects, facts, sessions
    def register_project(self, name: str, root: str, at_ms: int) -> None:
        """The one project; it keeps the time of its creation."""
        new = self._rows("projects", {"id": PROJECT, "name": name, "root_path": root, "created_at_ms": at_ms, "updated_at_ms": at_ms})
        old = self.read("projects").where(F.col("id") == PROJECT).select(F.col("created_at_ms").alias("old"))
        self.replace("projects", new.join(old, F.lit(True), "left").withColumn("created_at_ms", F.coalesce("old", "created_at_ms")))

    def remember(self, text: str, confidence: float | None = 1.0, sensitivity: str = "normal", scope: str = "project", at_ms: int | None = None) -> str:
        id_ = lifecycle.new_id("mem", at_ms)
        w = self.spark.createDataFrame([(id_, text, confidence, sensitivity, None, None, None, None)], "id string, text string, confidence double, sensitivity string, source_kind string, source_locator string, valid_from string, valid_to string")
        facts, refused = lifecycle.remember(w, scope, at_ms)
        if problem := refused.select("problem").first():
            raise ValueError(problem["problem"])
        self.append("memories", facts.withColumns({"valid_from": F.lit(None).cast("string"), "valid_to": F.lit(None).cast("string")}))
        return id_

    def forget(self, query: str, limit: int, now_ms: int) -> list[str]:
        m = self.read("memories")
        gone = memory.forget(m.where("valid_to is null"), query, limit, now_ms).select("id", F.col("valid_to").alias("ended"))
        ids = [r["id"] for r in gone.collect()]  # at most the limit
        self.replace("memories", m.join(F.broadcast(gone), "id", "left").withColumn("valid_to", F.coalesce("valid_to", "ended")))
        return ids

    def start_session(self, task: str, at_ms: int) -> str:
        id_ = lifecycle.new_id("ses", at_ms)
        self.append("sessions", self._rows("sessions", {"id": id_, "project_id": PROJECT, "task": task, "started_at_ms": at_ms}))
        return id_

    def _open(self) -> str | None:
        r = self.read("sessions").where("ended_at_ms is null").orderBy(F.desc("started_at_ms"), F.desc("id")).limit(1).collect()
        return r[0]["id"] if r else None

    def record_event(self, kind: str, detail: str, at_ms: int) -> bool:
        """An event of the newest open session, redacted; nothing without one."""
        open_ = self._open()
        if open_ is None:
            return False
        row = self._rows("session_events", {"id": lifecycle.new_id("evt", at_ms), "session_id": open_, "kind": kind, "detail": detail, "created_at_ms": at_ms})
        self.append("session_events", row.withColumn("detail", X.redact("detail")))
        return True

    def end_session(self, summary: str | None, at_ms: int) -> str | None:
        open_ = self._open()
        if open_ is not None:
            mine = F.col("id") == open_
            told = F.nullif(F.btrim(X.redact(F.lit(summary))), F.lit("")) if summary else F.lit(None).cast("string")
            self.replace("sessions", self.read("sessions").withColumn("ended_at_ms", F.when(mine, F.lit(at_ms)).otherwise(F.col("ended_at_ms"))).withColumn("final_summary", F.when(mine, told).otherwise(F.col("final_summary"))))
        return open_

    def _session_relations(self) -> tuple[DataFrame, DataFrame]:
        done = self.read("session_promotions").select(F.col("session_id").alias("done"))
        s = self.read("sessions").join(done, F.col("id") == F.col("done"), "left").withColumn("promoted", F.col("done").isNotNull()).withColumnRenamed("id", "session_id")
        return s, self.read("session_events").withColumn("seq", F.col("created_at_ms"))

    def promote(self, at_ms: int) -> str | None:
        """The fact that the session which ended first becomes; None if none is due."""
        s, e = self._session_relations()
        due = sessions.to_promote(s, e).orderBy("ended_at_ms", "session_id").limit(1).select("session_id").collect()
        if not due:
            return None
        one = s.where(F.col("session_id") == due[0]["session_id"])
        told = lifecycle.promotions(one, e, at_ms).first()
        id_ = lifecycle.new_id("mem", at_ms)
        self.append("memories", self._rows("memories", {"id": id_, "created_at_ms": at_ms, "kind": "fact", "text": told["text"], "confidence": 1.0, "sensitivity": "normal", "structured_payload": told["structured_payload"]}))
        self.append("session_promotions", self._rows("session_promotions", {"session_id": told["session_id"], "memory_id": id_, "promoted_at_ms": at_ms}))
        return id_

    # --- packs, index, replication
    def save_pack(self, task: str, payload: str, at_ms: int) -> str:
        id_ = lifecycle.new_id("pack", at_ms)
        self.append("context_packs", self._rows("context_packs", {"id": id_, "project_id": PROJECT, "task": task, "payload_json": payload, "created_at_ms": at_ms, "updated_at_ms": at_ms}))
        return id_

    def index(self, sources: DataFrame, at_ms: int, changed: DataFrame | None = None) -> dict:
        """Reads symbols and references of (path, language, size_bytes, text): of all files, or of some and what hangs on
        them; then test mappings follow."""
        mine = lambda d: d.withColumn("project_id", F.lit(PROJECT)).withColumn("indexed_at_ms", F.lit(at_ms).cast("long"))
        names = "path", "name", "kind", "line_start", "line_end", "signature"
        refs = "path", "line_start", "target_path", "target_name", "target_kind", "kind"
        s, r = indexing.full(sources) if changed is None else indexing.refresh(sources, changed, self.read("code_symbols").select(*names), self.read("code_references").select(*refs))
        language = sources.select("path", "language")
        self.replace("code_symbols", mine(s.join(language, "path", "left")))
        self.replace("code_references", mine(r.join(language, "path", "left").withColumn("excerpt", F.lit(""))))
        known = sources.select("path")
        old = self.read("test_mappings").select(F.col("source_path").alias("path"), "test_path", "score")
        tests = indexing.refresh_tests(old, known, known if changed is None else changed)
        self.replace("test_mappings", tests.select(F.lit(PROJECT).alias("project_id"), F.col("path").alias("source_path"), "test_path", F.lit("name").alias("reason"), "score", F.lit(at_ms).cast("long").alias("updated_at_ms")))
        stored = self.read("discovered_files").drop("project_id")
        self.replace("discovered_files", indexing.upsert_files(stored, sources, at_ms).withColumn("project_id", F.lit(PROJECT)))
        return {"symbols": self.read("code_symbols").count(), "references": self.read("code_references").count()}

    def synchronise(self, operation: str, other: Store, config: replication.Config, at_ms: int) -> DataFrame:
        """Pushes to or pulls from another store and keeps an audit of the run: its tables, why rows were passed over, and
        whether it failed."""
        names = replication.selected(config.classes)
        run, status = lifecycle.new_id("run", at_ms), "failed"
        try:
            local, remote = {n: self.read(n) for n in names}, {n: other.read(n) for n in names}
            to = other if operation == "push" else self
            told, passed = replication.executed(operation, local, remote, config, to.replace)
            status = "done"
        finally:
            self.append("sync_runs", self._rows("sync_runs", {"id": run, "operation": operation, "status": status, "started_at_ms": at_ms}))
        self.append("sync_table_runs", told.withColumn("run_id", F.lit(run)))
        self.append("sync_table_conflicts", passed.withColumn("run_id", F.lit(run)))
        return told

    def embed_files(self, sources: DataFrame, provider: embeddings.Provider, model: str, width: int, at_ms: int) -> int:
        """Brings the embeddings of files (path, text) up to date; how many were embedded."""
        texts = sources.where("text is not null").select(F.col("path").alias("id"), "text")
        old = self.read("source_embeddings")
        table = embeddings.refreshed(old.withColumnRenamed("path", "id"), texts, provider, model, width, key=V.content_key("text"))
        table = keep(table.withColumnRenamed("id", "path"), "embeddings")
        fresh = table.join(old.select("path", "model", "dimensions", "content_key"), ["path", "model", "dimensions", "content_key"], "left_anti").count()
        at = table.join(old.select("path", "model", "content_key", F.col("updated_at_ms").alias("old")), ["path", "model", "content_key"], "left")
        self.replace("source_embeddings", at.select(F.lit(PROJECT).alias("project_id"), "path", "model", "dimensions", "embedding", "content_key", F.coalesce("old", F.lit(at_ms).cast("long")).alias("updated_at_ms")))
        return fresh

    def status(self) -> dict:
        """Rows by table, and the configuration without its token."""
        config = replication.Config.read(os.environ)
        return {"folder": self.folder, "mode": config.mode, "remote": config.url, "token": bool(config.token), "classes": config.classes, "rows": {t: self.read(t).count() for _, ts in MIGRATIONS for t in ts}}


def install(agent_file: str, command: list[str]) -> bool:
    """Adds this engine to an agent's configuration of tool servers; False if it is there already. Nothing else changes."""
    place = Path(agent_file)
    doc = json.loads(place.read_text()) if place.exists() and place.read_text().strip() else {}
    entry = {"command": command[0], "args": command[1:]}
    servers = doc.setdefault("mcpServers", {})
    if servers.get("tessera") == entry:
        return False
    servers["tessera"] = entry
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(json.dumps(doc, indent=2) + "\n")
    return True
