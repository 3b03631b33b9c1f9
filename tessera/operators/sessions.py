"""Sessions, diagnostics and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.containment import containing


def facts(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, kind, detail, at): tasks, events and summaries in one relation."""
    task = sessions.where("task is not null").select("session_id", F.lit("task").alias("kind"), F.col("task").alias("detail"), F.col("started_at_ms").alias("at"))
    summary = sessions.where("final_summary is not null").select("session_id", F.lit("summary").alias("kind"), F.col("final_summary").alias("detail"), F.col("ended_at_ms").alias("at"))
    e = events.join(sessions.select("session_id", "started_at_ms"), "session_id").select("session_id", "kind", "detail", (F.col("started_at_ms") + F.col("seq") * 1000).alias("at"))
    return task.unionByName(e).unionByName(summary)


def fact_rank(facts_: DataFrame, query: str, newest: int = 100, limit: int = 5) -> DataFrame:
    """Of the newest facts those with most matched terms."""
    order = [F.desc("at"), F.col("session_id"), F.col("kind"), F.col("detail")]
    recent = facts_.orderBy(*order).limit(newest)
    score = X.contained(X.query_terms(F.lit(query)), F.lower(F.concat_ws(" ", "kind", "detail")))
    return recent.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *order).limit(limit)


def to_promote(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Ended sessions that are not promoted and have a summary or an event, oldest end first."""
    some = events.select("session_id").distinct().withColumn("has_event", F.lit(True))
    ended = sessions.where("ended_at_ms is not null and not promoted")
    return ended.join(some, "session_id", "left").where("final_summary is not null or has_event").select("session_id", "ended_at_ms")


def digest(sessions: DataFrame, events: DataFrame, first: int = 12) -> DataFrame:
    """(session_id, text): the first events in order, then the summary, as ``kind: detail`` joined by semicolons."""
    w = Window.partitionBy("session_id").orderBy("seq", "kind", "detail")
    told = lambda kind, detail: F.when(F.startswith(detail, F.concat(kind, F.lit(":"))), detail).otherwise(F.concat(kind, F.lit(": "), detail))
    e = events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= first).select("session_id", "n", told(F.col("kind"), F.col("detail")).alias("t"))
    s = sessions.where("final_summary is not null").select("session_id", F.lit(first + 1).alias("n"), told(F.lit("summary"), F.col("final_summary")).alias("t"))
    return e.unionByName(s).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "; ").alias("text"))


def latest(sessions: DataFrame) -> DataFrame:
    """One row: the newest open session and the newest of all, by end or else start."""
    last = F.coalesce("ended_at_ms", "started_at_ms")
    return sessions.agg(F.max_by("session_id", F.when(F.col("ended_at_ms").isNull(), F.struct("started_at_ms", "session_id"))).alias("open_session"), F.max_by("session_id", F.struct(last, F.col("session_id"))).alias("latest_session"))


def diagnostic_rank(diagnostics: DataFrame, query: str, paths: DataFrame, newest: int = 1000, limit: int = 8) -> DataFrame:
    """Of the newest diagnostics: 120 for a selected path, 20 a matched term, and 10 for errors among those."""
    recent = diagnostics.orderBy(F.desc("created_at_ms"), "id").limit(newest)
    # of all selected paths those that one of the newest has: no more rows than these
    selected = paths.select("path").join(F.broadcast(recent.select("path").distinct()), "path", "left_semi").distinct()
    hit = recent.join(F.broadcast(selected.withColumn("on_path", F.lit(True))), "path", "left")
    base = F.when(F.col("on_path"), 120).otherwise(0) + 20 * X.contained(X.query_terms(F.lit(query)), F.lower(F.concat_ws(" ", "severity", "path", "message")))
    score = F.when((base > 0) & (F.col("severity") == "error"), base + 10).otherwise(base)
    return hit.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("created_at_ms"), "id").limit(limit).select("id", "path", "severity", "score")


def normalise_diagnostics(rows: DataFrame) -> DataFrame:
    """Redacted, severities known, lines positive and in order; rows without a message drop out. Of (source, severity,
    line_start, message) and whatever other columns there are; a line_end before its start is left out."""
    s, start = F.lower(F.btrim("severity")), F.when(F.col("line_start") > 0, F.col("line_start"))
    told = {
        "source": F.replace(F.lower(F.btrim("source")), F.lit(" "), F.lit("_")),
        "severity": F.when(s.isin("error", "warning", "note", "info", "help"), s).otherwise("error"),
        "line_start": start,
        "message": F.btrim(X.redact("message")),
    }
    if "line_end" in rows.columns:
        told["line_end"] = F.when(F.col("line_end") >= F.coalesce(start, F.lit(1)), F.col("line_end"))
    return rows.withColumns(told).where("message <> ''")


def freshness(files: DataFrame, indexed: DataFrame, limit: int = 12, slack_ms: int = 1000) -> DataFrame:
    """(path, kind, modified_at_ms): files changed after their newest index entry, or in none; index misses last."""
    newest = indexed.groupBy("path").agg(F.max("indexed_at_ms").alias("indexed_at_ms"))
    j = files.join(newest, "path", "left")
    kind = F.when(F.col("indexed_at_ms").isNull(), "missing_index").when(F.col("modified_at_ms") > F.col("indexed_at_ms") + slack_ms, "stale_index")
    order = F.when(F.col("kind") == "stale_index", 2).otherwise(1)
    return j.withColumn("kind", kind).where("kind is not null").orderBy(F.desc(order), F.desc_nulls_last("modified_at_ms"), "path").limit(limit).select("path", "kind", "modified_at_ms")


# How kinds of staleness rank.
FRESHNESS_RANK = {"edit_after_context": 4, "stale_context": 3, "stale_index": 2, "missing_index": 1}


def freshness_signals(paths: DataFrame, files: DataFrame, indexed: DataFrame, edits: DataFrame, packed_at_ms: int, limit: int = 12, slack_ms: int = 1000) -> DataFrame:
    """(task_id, path, kind, modified_at_ms) of selected paths (task_id, path): edited after the last pack (edits: detail,
    at), changed on disk after it (files: path, modified_at_ms), changed after their newest index entry, or in none. What
    is known of a path is looked up once, however many tasks have it."""
    chosen = paths.select("task_id", "path").distinct()
    once = chosen.select("path").distinct()
    disk = once.join(files, "path", "left")
    many = 3 * limit
    first = lambda d, *order: chosen.join(d, "path").withColumn("k", F.row_number().over(Window.partitionBy("task_id").orderBy(*order)))
    newest = indexed.groupBy("path").agg(F.max("indexed_at_ms").alias("indexed_at_ms"))
    kind = F.when(F.col("indexed_at_ms").isNull(), "missing_index").when(F.col("modified_at_ms") > F.col("indexed_at_ms") + slack_ms, "stale_index")
    index = first(disk.join(newest, "path", "left").withColumn("kind", kind).where("kind is not null"), F.col("kind") == "missing_index", F.desc_nulls_last("modified_at_ms"), "path")
    aged = first(disk.where(F.col("modified_at_ms") > packed_at_ms + slack_ms).withColumn("kind", F.lit("stale_context")), "path")
    edited = chosen.join(edits_after(once, edits, packed_at_ms), "path").select("task_id", "path", F.lit("edit_after_context").alias("kind"), F.col("edited_at_ms").alias("modified_at_ms"))
    cut = lambda d: d.where(F.col("k") <= many).select("task_id", "path", "kind", "modified_at_ms")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in FRESHNESS_RANK.items() for x in kv]), F.col("kind"))
    w = Window.partitionBy("task_id").orderBy(F.desc(rank), F.desc_nulls_last("modified_at_ms"), "path")
    return cut(index).unionByName(cut(aged)).unionByName(edited).withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def edits_after(paths: DataFrame, events: DataFrame, packed_at_ms: int) -> DataFrame:
    """(path, edited_at_ms): the newest edit of a path after the last pack, an event (detail, at) whose detail contains the
    path, in whatever words or longer path it stands. Equal details are one."""
    told = events.where(F.col("at") > packed_at_ms).groupBy("detail").agg(F.max("at").alias("at")).withColumn("key", F.sha2("detail", 256))
    met = containing(told.select("key", F.col("detail").alias("text")), paths.select(F.col("path").alias("needle")))
    return met.join(told.select("key", "at"), "key").groupBy(F.col("needle").alias("path")).agg(F.max("at").alias("edited_at_ms"))
