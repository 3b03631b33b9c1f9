"""Background work as streams: file events, indexing, session state and the periodic ticks. A tick is a stream of its own
clock, one micro-batch at a time, so that none overlaps the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import paths as P
from tessera.operators import sessions
from tessera.sources import workspace as W

EVENTS = "ts timestamp, project_id string, path string"
MAINTENANCE, PROMOTION = "15 minutes", "5 minutes"


def file_events(spark: SparkSession, folder: str, ignore: list[str] = ()) -> DataFrame:
    """File events of a folder of JSON lines, (ts, project_id, path), without those of skipped and ignored paths."""
    rows = spark.readStream.schema(EVENTS).json(folder)
    return rows.where(F.col("path").isNotNull() & ~P.is_skipped("path") & ~W.ignored("path", W.ignore_rules(list(ignore))))


def index_changes(events: DataFrame, update: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls ``update`` with the distinct changed paths, sorted, of every micro-batch that has any; batches wait for each
    other and none is dropped."""

    def run(batch: DataFrame, _: int) -> None:
        paths = batch.select("path").distinct().orderBy("path")
        if paths.head(1):
            update(paths)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "open string, next long"
LOG = "project string, session long, what string, at long, detail string"


def session_states(commands: DataFrame) -> DataFrame:
    """A stream of (project, at, place, action, detail) as rows (project, session, what, at, detail): ``start``, ``end`` and
    events, each with the session it belongs to, the project's newest open one. What is kept of a project is the stack of
    its open sessions; the batch twin is ``lifecycle.session_log``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, number = state.get if state.exists else ("", 0)
        stack, out = [int(x) for x in open_.split(",") if x], []
        for r in pd.concat(list(batches)).sort_values(["at", "place"], kind="stable").itertuples(index=False):
            if r.action == "start":
                stack.append(number)
                number += 1
                out.append((key[0], stack[-1], "start", r.at, r.detail))
            elif stack:
                out.append((key[0], stack.pop() if r.action == "end" else stack[-1], r.action, r.at, r.detail))
        state.update((",".join(map(str, stack)), number))
        yield pd.DataFrame(out, columns=["project", "session", "what", "at", "detail"])

    return commands.groupBy("project").applyInPandasWithState(run, LOG, STATE, "append", GroupStateTimeout.NoTimeout)


def tick(spark: SparkSession, every: str, work: Callable[[], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls ``work`` each time the clock ticks; ticks that pass while it runs are skipped."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(lambda batch, _: work()).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def maintenance_tick(spark: SparkSession, work: Callable[[], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    return tick(spark, MAINTENANCE, work, checkpoint, once)


def promotion_tick(spark: SparkSession, tables: Callable[[], tuple[DataFrame, DataFrame]], promote: Callable[[int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """One session a tick, the one that ended first; ``tables`` gives sessions and events as they are then."""

    def work() -> None:
        due = sessions.to_promote(*tables()).orderBy("ended_at_ms", "session_id").limit(1).collect()  # one row
        if due:
            promote(due[0]["session_id"])

    return tick(spark, PROMOTION, work, checkpoint, once)
