"""Life of facts and sessions: writing, promoting, reporting. Operators return the rows to write; sinks are the store's."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import memory, sessions

#: How many characters of facts a synthesiser gets, and of its answer are kept.
FACT_CHARS, ANSWER_CHARS = 12_000, 2_000


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def new_id(prefix: str, at_ms: int | None = None) -> str:
    """An id that sorts by time and is nobody else's."""
    return f"{prefix}_{now_ms() if at_ms is None else at_ms:013d}_{uuid.uuid4().hex[:8]}"


def payload(source_kind: Column, source_locator: Column, confidence: Column, sensitivity: Column, valid_from: Column, valid_to: Column, scope: Column) -> Column:
    """What is known of a fact beyond its text, as JSON; missing parts are left out, and so is all if there is none."""
    some = lambda *cs: F.coalesce(*(c.isNotNull() & F.lit(True) for c in cs)) if len(cs) == 1 else cs[0].isNotNull() | cs[1].isNotNull()
    source = F.when(some(source_kind), F.struct(F.lit("manual").alias("type"), source_kind.alias("kind"), source_locator.alias("locator")))
    validity = F.when(some(valid_from, valid_to), F.struct(valid_from.alias("valid_from"), valid_to.alias("valid_to")))
    metadata = F.when(confidence.isNotNull() | sensitivity.isNotNull() | validity.isNotNull(), F.struct(confidence.alias("confidence"), sensitivity.alias("sensitivity"), validity.alias("validity")))
    whole = F.to_json(F.struct(scope.alias("scope"), source.alias("source"), metadata.alias("metadata")))
    return F.when(whole != "{}", whole)


def from_session(payload_: Column | str, session_id: Column | str) -> Column:
    """Whether a fact's payload says that it comes from a session; what is no JSON says nothing."""
    j = lambda p: F.get_json_object(X.col(payload_), p)
    return F.coalesce((j("$.source.type") == "session") & (j("$.source.session_id") == X.col(session_id).cast("string")), F.lit(False))


def remember(writes: DataFrame, scope: str = "project", at_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts to append, refused writes with their problem) of (id, text, confidence, sensitivity, source_kind,
    source_locator, valid_from, valid_to). A fact's kind is ``fact`` whatever it says; its text is trimmed."""
    told = memory.validate(writes)
    at = now_ms() if at_ms is None else at_ms
    whole = payload(*map(F.col, ("source_kind", "source_locator", "confidence", "sensitivity", "valid_from", "valid_to")), F.lit("global") if scope == "global" else F.lit(None).cast("string"))
    facts = told.where("problem is null").select(
        "id", F.lit(at).cast("long").alias("created_at_ms"), F.lit("fact").alias("kind"), F.btrim("text").alias("text"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("sensitivity", F.lit("normal")).alias("sensitivity"), F.lit(None).cast("string").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"), F.lit(scope).alias("scope"), whole.alias("structured_payload"),
    )
    return facts, told.where("problem is not null")


def maintenance(memories: DataFrame, signals=X.SIGNALS) -> DataFrame:
    """One row: how many facts there are and hold, how many are copies and in how many groups, how many pairs conflict."""
    active = memories.where("valid_to is null")
    groups = memory.duplicate_groups(active)
    one = [
        memories.agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull()).alias("active")),
        groups.agg(F.countDistinct("key").alias("groups"), F.count("*").alias("copies")),
        memory.contradictions(active, signals).agg(F.count("*").alias("conflicts")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(F.broadcast(x))  # one row each
    return out


def session_log(commands: DataFrame) -> DataFrame:
    """(project, session, started_at_ms, ended_at_ms, summary, events) of (project, at, place, action, detail) in order:
    ``start`` opens a session, any other action is an event of the project's newest open session, ``end`` closes it with
    a redacted summary. Events and ends without an open session say nothing. A project's commands are its state, so one
    project is one group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        open_, all_ = [], []
        for r in rows.sort_values(["at", "place"], kind="stable").itertuples(index=False):
            if r.action == "start":
                open_.append({"project": key[0], "session": len(all_), "started_at_ms": r.at, "ended_at_ms": None, "summary": None, "events": 0})
                all_.append(open_[-1])
            elif open_ and r.action == "end":
                open_.pop().update(ended_at_ms=r.at, summary=(r.detail or "").strip() or None)
            elif open_:
                open_[-1]["events"] += 1
        out = pd.DataFrame(all_, columns=["project", "session", "started_at_ms", "ended_at_ms", "summary", "events"])
        return out.astype({"ended_at_ms": "Int64", "summary": object})

    kind = dict(commands.dtypes)["project"]
    out = commands.groupBy("project").applyInPandas(run, f"project {kind}, session long, started_at_ms long, ended_at_ms long, summary string, events long")
    return out.withColumn("summary", X.redact("summary"))


def promotions(sessions_: DataFrame, events: DataFrame, at_ms: int, first: int = 12) -> DataFrame:
    """(session_id, text, structured_payload, fact_count, created_at_ms): the fact that each session that is due becomes."""
    due = sessions.to_promote(sessions_, events).select("session_id")
    chosen = sessions_.join(due, "session_id", "left_semi")
    mine = events.join(due, "session_id", "left_semi")
    n = mine.groupBy("session_id").agg(F.least(F.count("*"), F.lit(first)).alias("n"))
    rows = sessions.digest(chosen, mine, first).join(chosen.select("session_id", "task", "final_summary"), "session_id").join(n, "session_id", "left")
    count = F.coalesce("n", F.lit(0)) + F.when(F.col("final_summary").isNotNull(), 1).otherwise(0)
    source = F.struct(F.struct(F.lit("session").alias("type"), F.col("session_id").cast("string").alias("session_id"), count.alias("fact_count")).alias("source"))
    told = F.concat(F.lit("Findings of the session '"), F.coalesce("task", F.lit("")), F.lit("': "), "text")
    return rows.select("session_id", told.alias("text"), F.to_json(source).alias("structured_payload"), count.alias("fact_count"), F.lit(at_ms).cast("long").alias("created_at_ms"))


def promoted(sessions_: DataFrame, promotions_: DataFrame, memories: DataFrame) -> DataFrame:
    """(session_id, memory_id): the fact a session has become, by its promotion or else by what the fact's payload says."""
    by_row = promotions_.join(memories.select(F.col("id").alias("memory_id")), "memory_id").select("session_id", "memory_id")
    told = memories.select(F.col("id").alias("said"), F.get_json_object("structured_payload", "$.source.session_id").alias("of"), F.get_json_object("structured_payload", "$.source.type").alias("type")).where("type = 'session'")
    by_payload = told.groupBy("of").agg(F.min("said").alias("said"))
    j = sessions_.select("session_id").join(by_row, "session_id", "left").join(by_payload, F.col("session_id").cast("string") == F.col("of"), "left")
    return j.select("session_id", F.coalesce("memory_id", "said").alias("memory_id")).where("memory_id is not null")


def synthesised(task: str, facts: str, synthesiser: Callable[[str, str], str] | None) -> str | None:
    """What a synthesiser makes of a session's facts; None, so that the plain text is used, if there is none or it fails."""
    if synthesiser is None:
        return None
    try:
        return synthesiser(task, facts[:FACT_CHARS]).strip()[:ANSWER_CHARS] or None
    except Exception:  # a model that fails must not keep a session from being promoted
        return None
