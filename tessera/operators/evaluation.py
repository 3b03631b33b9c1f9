"""Retrieval evaluated by replaying commits: a commit's subject is the task, the source files it changed are what a pack
should have. All cases are searched in one plan; they are a stated set that meets all files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.sources.scratch import keep

SYMBOL_BONUS = 6


def cases(commits: DataFrame, existing: DataFrame, wanted: int = 30, most_files: int = 8) -> tuple[DataFrame, DataFrame]:
    """((hash, task, expected), (reason, n)) of commits (place, hash, subject, files), newest first: the first ``wanted``
    that can be a case, and why others up to there cannot."""
    c = commits.select("place", "hash", X.commit_task("subject").alias("task"), F.explode_outer("files").alias("path"))
    there = existing.select("path", F.lit(True).alias("there")).distinct()
    good = F.when(F.col("there") & P.is_likely_source("path"), F.col("path"))
    g = c.join(there, "path", "left").groupBy("place", "hash", "task").agg(F.sort_array(F.collect_list(good)).alias("expected"))
    n = F.size("expected")
    reason = F.when(F.size(X.selective_terms("task")) < 2, "short_subject").when(n == 0, "no_source_files").when(n > most_files, "too_many_files")
    told = g.withColumn("reason", reason)
    ok = told.where("reason is null").orderBy("place").limit(wanted)
    last = ok.agg(F.count("*").alias("k"), F.max("place").alias("last"))  # one row
    skipped = told.where("reason is not null").crossJoin(F.broadcast(last)).where((F.col("k") < wanted) | (F.col("place") < F.col("last")))
    return ok.select("hash", "task", "expected"), skipped.groupBy("reason").agg(F.count("*").alias("n"))


def _top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("hash").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def replay(cases_: DataFrame, files: DataFrame, symbols: DataFrame, n_files: int = 12, n_symbols: int = 8) -> DataFrame:
    """(hash, recall, first_hit_rank, symbol_hit, candidate_hit, retrievable) of each case: files (path, size_bytes) ranked
    by name and raised or added by the symbols (path, name, kind, signature, line_start) that the task recalls. The cases,
    as many as were asked for, and what each finds are written down first, as they are used in several places."""
    cases_ = keep(cases_, "cases")
    # what does not depend on the other side is told once a case, once a file and once a symbol, before they meet
    q = F.broadcast(keep(cases_.select("hash", "task", X.selective_terms("task").alias("terms"), X.query_terms("task").alias("q_terms")), "queries"))
    of_file, of_symbol = P.file_parts(F.col("path")), X.symbol_parts(*map(F.col, ("name", "path", "kind", "signature")))
    told = lambda parts: {n: F.col(n) for n in parts}
    ready = lambda rows, parts, *columns: rows.select(*columns, *(c.alias(n) for n, c in parts.items()))
    f = ready(files, of_file, "path", "size_bytes").crossJoin(q).withColumn("lexical", P.file_fit(told(of_file), F.col("terms"))).where("lexical > 0")
    f = f.withColumn("relevance", P.relevance(F.col("lexical"), F.lit(None).cast("int"), F.col("size_bytes")))
    candidates = _top(f, n_files, F.desc("relevance"), F.col("path")).select("hash", "path", "size_bytes", "lexical")
    candidates = keep(candidates, "candidates")
    s = ready(symbols, of_symbol, "path", "line_start").crossJoin(q).withColumn("score", X.symbol_fit(told(of_symbol), F.col("q_terms"), F.col("task"))).where("score > 0")
    s = _top(s, n_symbols, F.desc("score"), F.col("path"), F.col("line_start")).select("hash", "path").distinct()
    s = keep(s, "symbols")
    both = candidates.join(s.withColumn("bonus", F.lit(SYMBOL_BONUS)), ["hash", "path"], "full")
    lexical = F.coalesce("lexical", F.lit(0)) + F.coalesce("bonus", F.lit(0))
    pack = _top(both.withColumn("relevance", P.relevance(lexical, F.lit(None).cast("int"), F.col("size_bytes"))), 10**6, F.desc("relevance"), F.col("path"))
    want = cases_.select("hash", F.explode("expected").alias("path"))
    found = pack.join(want.distinct(), ["hash", "path"]).groupBy("hash").agg(F.min("rank").alias("first_hit_rank"))
    covered = want.join(pack.select("hash", "path"), ["hash", "path"], "left_semi").groupBy("hash").agg(F.count("*").alias("covered"))
    any_ = lambda d, name: d.join(want.distinct(), ["hash", "path"], "left_semi").select("hash").distinct().withColumn(name, F.lit(True))
    j = cases_.join(found, "hash", "left").join(covered, "hash", "left").join(any_(s, "symbol_hit"), "hash", "left").join(any_(candidates, "candidate_hit"), "hash", "left")
    named = F.exists(X.selective_terms("task"), lambda t: F.exists("expected", lambda p: F.contains(F.lower(p), t)))
    no = F.lit(False)
    return j.select("hash", F.round(F.coalesce("covered", F.lit(0)) / F.size("expected"), 6).alias("recall"), F.col("first_hit_rank").cast("long").alias("first_hit_rank"), F.coalesce("symbol_hit", no).alias("symbol_hit"), F.coalesce("candidate_hit", no).alias("candidate_hit"), named.alias("retrievable"))


def means(scores: DataFrame) -> DataFrame:
    """One row: how many cases, and the mean of each measure, 0 without cases."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    return scores.agg(
        F.count("*").alias("cases"), mean(F.col("recall")).alias("recall"), mean(F.when(F.col("first_hit_rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"),
        mean(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0))).alias("mrr"), mean(flag("symbol_hit")).alias("symbol_hit_rate"), mean(flag("candidate_hit")).alias("candidate_hit_rate"), mean(flag("retrievable")).alias("retrievable_rate"),
    )


def gate(means_: DataFrame, least_hit_rate: float) -> float:
    """The hit rate; an error if there are no cases or it is too low."""
    r = means_.first()
    if not r["cases"]:
        raise ValueError("no commit could be evaluated")
    if r["hit_rate"] < least_hit_rate:
        raise ValueError(f"hit rate {r['hit_rate']:.3f} is below {least_hit_rate:.3f}")
    return r["hit_rate"]
