"""Replication as merges of two relations, one full outer join each; every policy also counts what it did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    mine = local.select(F.col(key), F.struct(*local.columns).alias("l"))
    theirs = remote.select(F.col(key), F.struct(*local.columns).alias("r"))
    return mine.join(theirs, key, "full")


def _merged(both: DataFrame, take_remote, columns: list[str]) -> DataFrame:
    take = F.col("r").isNotNull() & (F.col("l").isNull() | take_remote)
    return both.select(F.when(take, F.col("r")).otherwise(F.col("l")).alias("row")).select(*(f"row.{c}" for c in columns))


def push(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """The remote side after a push: local rows always win."""
    return _merged(_both(remote, local, key), F.lit(True), remote.columns)


def pull_newer(local: DataFrame, remote: DataFrame, key: str, at: str) -> DataFrame:
    """The local side after a pull: a remote row wins only if it is strictly newer."""
    return _merged(_both(local, remote, key), F.col(f"r.{at}") > F.col(f"l.{at}"), local.columns)


def pull_missing(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Rows that are there are kept; others are added."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti").select(local.columns))


def pull_retirement(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Facts never change their text; an end that only the remote row has is taken over."""
    b = _both(local, remote, key)
    keep = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")) if c in ("valid_to", "superseded_by") else F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")) for c in local.columns]
    return b.select(*(k.alias(c) for k, c in zip(keep, local.columns, strict=True)))


def pull_sessions(local: DataFrame, remote: DataFrame, key: str = "session_id") -> DataFrame:
    """A remote session wins if the local one is open or ended earlier; only finished ones come over."""
    done = remote.where("final_summary is not null")
    return _merged(_both(local, done, key), F.col("l.ended_at_ms").isNull() | (F.col("r.ended_at_ms") > F.col("l.ended_at_ms")), local.columns)


def conflicts(local: DataFrame, remote: DataFrame, key: str, at: str) -> DataFrame:
    """(reason, n) of a pull that takes newer rows."""
    b = _both(local, remote, key).where("r is not null")
    reason = F.when(F.col("l").isNull(), "inserted").when(F.col(f"r.{at}") > F.col(f"l.{at}"), "updated").otherwise("local_row_newer_or_equal")
    return b.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def orphans(children: DataFrame, parents: DataFrame, key: str, reason: str) -> DataFrame:
    """(reason, n): rows whose parent is missing, which a merge skips."""
    return children.join(parents.select(key), key, "left_anti").agg(F.lit(reason).alias("reason"), F.count("*").alias("n"))
