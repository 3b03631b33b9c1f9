"""Replication of the model's tables: which belong to which class, codecs, push and pull by each table's own policy, what
a run did, and its audit. Merges are those of ``sync``."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import sync
from tessera.sources.scratch import keep

# The tables of each class in their order, the classes that stand by default and those that stand for no table.
CLASSES = {
    "memories": ["memories"], "sources": ["sources", "discovered_files", "test_mappings"], "entities": ["entities", "code_symbols"], "edges": ["edges", "code_references"],
    "embeddings": ["memory_embeddings", "source_embeddings"], "session_summaries": ["sessions"], "context_packs": ["context_packs"], "diagnostics": ["diagnostics"],
    "full_source": [], "raw_command_output": [], "secrets": [], "private_notes": [],
}
DEFAULT = ["memories", "sources", "entities", "edges", "embeddings", "context_packs", "diagnostics", "session_summaries"]


@dataclass(frozen=True)
class Table:
    """Columns with their types, the key, and how a pull treats rows that are there: ``newer`` (by ``at``), ``keep``,
    ``retire`` (facts) or ``session``. Rows whose ``parent`` (table, column) is missing are skipped."""

    schema: str
    key: tuple[str, ...]
    pull: str
    at: str | None = None
    parent: tuple[str, str] | None = None


TABLES = {
    "projects": Table("id string, name string, root_path string, git_remote string, default_branch string, created_at_ms long, updated_at_ms long", ("id",), "newer", "updated_at_ms"),
    "memories": Table("id string, created_at_ms long, kind string, text string, confidence double, valid_from string, valid_to string, superseded_by string, sensitivity string, structured_payload string", ("id",), "retire"),
    "memory_embeddings": Table("memory_id string, model string, dimensions int, embedding array<float>", ("memory_id",), "keep", parent=("memories", "memory_id")),
    "sources": Table("id string, kind string, locator string, created_at_ms long", ("id",), "keep"),
    "entities": Table("id string, kind string, name string, locator string, created_at_ms long", ("id",), "keep"),
    "edges": Table("id string, from_id string, to_id string, kind string, created_at_ms long", ("id",), "keep"),
    "discovered_files": Table("project_id string, path string, language string, size_bytes long, discovered_at_ms long, updated_at_ms long", ("project_id", "path"), "newer", "updated_at_ms"),
    "sessions": Table("id string, project_id string, task string, branch string, started_at_ms long, ended_at_ms long, final_summary string", ("id",), "session"),
    "context_packs": Table("id string, project_id string, task string, payload_json string, created_at_ms long, updated_at_ms long", ("id",), "newer", "updated_at_ms"),
    "diagnostics": Table("id string, project_id string, source string, path string, line_start long, line_end long, severity string, code string, message string, command string, created_at_ms long", ("id",), "keep"),
    "code_symbols": Table("project_id string, path string, language string, name string, kind string, line_start long, line_end long, signature string, indexed_at_ms long", ("project_id", "path", "kind", "name", "line_start"), "newer", "indexed_at_ms"),
    "code_references": Table("project_id string, path string, language string, target_path string, target_name string, target_kind string, kind string, line_start long, excerpt string, indexed_at_ms long", ("project_id", "path", "target_path", "target_name", "line_start", "kind"), "newer", "indexed_at_ms"),
    "test_mappings": Table("project_id string, source_path string, test_path string, reason string, score int, updated_at_ms long", ("project_id", "source_path", "test_path"), "newer", "updated_at_ms"),
    "source_embeddings": Table("project_id string, path string, model string, dimensions int, embedding array<float>, content_key string, updated_at_ms long", ("project_id", "path"), "newer", "updated_at_ms"),
    "session_events": Table("id string, session_id string, kind string, detail string, created_at_ms long", ("id",), "keep", parent=("sessions", "session_id")),
    "session_promotions": Table("session_id string, memory_id string, promoted_at_ms long", ("session_id",), "keep", parent=("sessions", "session_id")),
}


def classes(value: str | None) -> list[str]:
    """Classes by name, separated by commas; nothing or ``default`` for the usual ones, ``none`` for none."""
    text = (value or "").strip().lower()
    if text in ("", "default"):
        return list(DEFAULT)
    if text == "none":
        return []
    out = []
    for name in (x.strip().replace("-", "_") for x in text.split(",")):
        if name not in CLASSES:
            raise ValueError(f"no such class: {name}")
        if name not in out:
            out.append(name)
    return out


def selected(classes_: list[str]) -> list[str]:
    """The tables of some classes, each once, projects first."""
    return list(dict.fromkeys(["projects", *(t for c in classes_ for t in CLASSES[c])]))


@dataclass
class Config:
    """Where a store is and what it shares; modes but ``local`` need a remote place and a token."""

    mode: str = "local"
    url: str | None = None
    token: str | None = None
    classes: list[str] = field(default_factory=lambda: list(DEFAULT))

    MODES = ("local", "hybrid", "remote")
    NAMES = {"mode": ["TESSERA_STORAGE_MODE"], "url": ["TESSERA_REMOTE_URL", "TESSERA_API_URL"], "token": ["TESSERA_REMOTE_TOKEN", "TESSERA_API_TOKEN"], "classes": ["TESSERA_SYNC_CLASSES"]}

    @classmethod
    def read(cls, settings: Mapping[str, str]) -> Config:
        """From settings such as the environment; of several names the first that is not empty."""
        first = {k: next((v for n in names if (v := (settings.get(n) or "").strip())), None) for k, names in cls.NAMES.items()}
        mode = first["mode"] or "local"
        if mode not in cls.MODES:
            raise ValueError(f"no such mode: {mode}")
        if mode != "local" and not (first["url"] and first["token"]):
            raise ValueError(f"mode {mode} needs a remote place and a token")
        return cls(mode, first["url"], first["token"], classes(first["classes"]))


def _key(table: str, rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", F.struct(*TABLES[table].key))


def shared(table: str, rows: DataFrame) -> DataFrame:
    """What of a table is replicated: of sessions only finished ones."""
    return rows.where("final_summary is not null") if table == "sessions" else rows


def encode(table: str, rows: DataFrame) -> DataFrame:
    """(record): rows as JSON objects of the table's columns; missing values are left out."""
    names = [c.split()[0] for c in TABLES[table].schema.split(", ")]
    return rows.select(F.to_json(F.struct(*names)).alias("record"))


def decode(table: str, records: DataFrame) -> DataFrame:
    """Rows of (record); one that is no such object is an error."""
    return records.select(F.from_json("record", TABLES[table].schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def accepted(table: str, rows: DataFrame, parents: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their parent, (reason, n) of the others)."""
    parent = TABLES[table].parent
    if parent is None or parents is None:
        return rows, rows.sparkSession.createDataFrame([], "reason string, n long")
    ids = parents.select(F.col("id").alias(parent[1])).distinct()
    reason = f"missing_{parent[0].rstrip('s') if parent[0] != 'memories' else 'memory'}"
    return rows.join(ids, parent[1], "left_semi").select(rows.columns), sync.orphans(rows, ids, parent[1], reason).where("n > 0")


def push(table: str, local: DataFrame, remote: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """The remote table after a push: what is shared and has its parent there always wins."""
    mine, _ = accepted(table, shared(table, local), parents)
    return sync.push(_key(table, mine), _key(table, remote), "_key").select(remote.columns)


def pull(table: str, local: DataFrame, remote: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """The local table after a pull, by the table's policy."""
    t = TABLES[table]
    theirs, _ = accepted(table, shared(table, remote), parents)
    mine, theirs = _key(table, local), _key(table, theirs)
    if t.pull == "newer":
        out = sync.pull_newer(mine, theirs, "_key", t.at)
    elif t.pull == "retire":
        out = sync.pull_retirement(mine, theirs, "_key")
    elif t.pull == "session":
        out = sync.pull_sessions(mine, theirs, "_key")
    else:
        out = sync.pull_missing(mine, theirs, "_key")
    return out.select(local.columns)


def stats(table: str, before: DataFrame, after: DataFrame, offered: DataFrame) -> DataFrame:
    """One row: (table, before, after, inserted, updated, skipped) of a merge; a row is updated if any column differs."""
    key = lambda d, name: _key(table, d).select("_key", F.xxhash64(F.to_json(F.struct(*before.columns))).alias(name))
    j = key(before, "b").join(key(after, "a"), "_key", "full").join(_key(table, offered).select("_key", F.lit(True).alias("o")).distinct(), "_key", "left")
    inserted, updated = F.col("b").isNull(), F.col("b").isNotNull() & (F.col("b") != F.col("a"))
    return j.agg(
        F.lit(table).alias("table"), F.count_if(F.col("b").isNotNull()).alias("before"), F.count_if(F.col("a").isNotNull()).alias("after"),
        F.count_if(inserted).alias("inserted"), F.count_if(updated).alias("updated"), F.count_if(F.col("o") & ~inserted & ~updated).alias("skipped"),
    )


def plan(tables: Mapping[str, DataFrame], classes_: list[str]) -> DataFrame:
    """(table, rows): what a run over some classes would offer; nothing is written."""
    out = None
    for name in selected(classes_):
        if name in tables:
            one = shared(name, tables[name]).agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
            out = one if out is None else out.unionByName(one)
    return out


def executed(operation: str, local: Mapping[str, DataFrame], remote: Mapping[str, DataFrame], config: Config, write: Callable[[str, DataFrame], None]) -> tuple[DataFrame, DataFrame]:
    """(stats, (table, reason, n)) of a run that stores each merged table, with why rows were passed over: those that the
    table's policy left as they were, and those without their parent. Both have a few rows a table."""
    told = run(operation, local, remote, config, write).collect()
    rows = [(r["table"], "local_row_newer_or_equal" if TABLES[r["table"]].pull == "newer" else "local_row_preserved", r["skipped"]) for r in told if operation == "pull" and r["skipped"]]
    offered, to = (local, remote) if operation == "push" else (remote, local)
    for r in told:
        name, parent = r["table"], TABLES[r["table"]].parent
        if parent and parent[0] in to:
            rows += [(name, x["reason"], x["n"]) for x in accepted(name, shared(name, offered[name]), to[parent[0]])[1].collect()]
    spark = next(iter(local.values())).sparkSession
    stats_ = spark.createDataFrame(told, "table string, before long, after long, inserted long, updated long, skipped long")
    return stats_, spark.createDataFrame(rows, "table string, reason string, n long")


def run(operation: str, local: Mapping[str, DataFrame], remote: Mapping[str, DataFrame], config: Config, write: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """Pushes or pulls all tables of the configured classes and returns their stats; ``write`` stores each merged table.
    Without it the run is dry."""
    if write is not None and config.mode != "hybrid":
        raise ValueError("only a hybrid store is replicated")
    out = None
    for name in selected(config.classes):
        if name not in local or name not in remote:
            continue
        mine, theirs = local[name], remote[name]
        to, offered = (theirs, mine) if operation == "push" else (mine, theirs)
        parent = TABLES[name].parent
        parents = (remote if operation == "push" else local).get(parent[0]) if parent else None
        after = (push if operation == "push" else pull)(name, mine, theirs, parents)
        after = after if write is None else keep(after, name)  # merged once
        one = stats(name, to, after, shared(name, offered))
        out = one if out is None else out.unionByName(one)
        if write is not None:
            write(name, after)
    return out


def history(runs: DataFrame, tables: DataFrame, conflicts: DataFrame, limit: int) -> DataFrame:
    """The newest runs (id, operation, status, started_at_ms) with their tables (run_id, table, inserted, updated) and the
    conflicts of these (run_id, table, reason, n), nested."""
    newest = runs.orderBy(F.desc("started_at_ms"), "id").limit(limit)
    c = conflicts.groupBy("run_id", "table").agg(F.sort_array(F.collect_list(F.struct("reason", "n"))).alias("conflicts"))
    t = tables.join(c, ["run_id", "table"], "left").groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("table", "inserted", "updated", "conflicts"))).alias("tables"))
    return newest.join(t, newest.id == t.run_id, "left").drop("run_id")
