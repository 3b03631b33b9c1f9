"""Files: ranking for a task, promotion by symbols, merges, tests of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X

SYMBOL_BONUS = 6
LEAST_STEM = 3


def candidates(files: DataFrame, task: str, limit: int | None = 12) -> DataFrame:
    """(path, lexical_score, relevance) of (path, size_bytes), best first."""
    scored = files.withColumn("lexical_score", P.file_score(F.col("path"), X.selective_terms(F.lit(task)))).where("lexical_score > 0")
    out = scored.select("path", "size_bytes", "lexical_score", P.relevance(F.col("lexical_score"), F.lit(None).cast("int"), F.col("size_bytes")).alias("relevance"))
    return out if limit is None else out.orderBy(F.desc("relevance"), "path").limit(limit)


def promote(candidates_: DataFrame, symbol_paths: DataFrame) -> DataFrame:
    """Files that define a recalled symbol gain points; those not yet there are added."""
    s = symbol_paths.select("path").distinct()
    known = candidates_.join(s.withColumn("has", F.lit(SYMBOL_BONUS)), "path", "left").withColumn("lexical_score", F.col("lexical_score") + F.coalesce("has", F.lit(0))).drop("has")
    new = s.join(candidates_.select("path"), "path", "left_anti").select("path", F.lit(None).cast("long").alias("size_bytes"), F.lit(SYMBOL_BONUS).alias("lexical_score"), F.lit(0).alias("relevance"))
    both = known.unionByName(new)
    return both.withColumn("relevance", P.relevance(F.col("lexical_score"), F.lit(None).cast("int"), F.col("size_bytes")))


def merge(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Per path the highest lexical score and the lowest vector rank."""
    both = lexical.select("path", "lexical_score", F.lit(None).cast("int").alias("embedding_rank"), "size_bytes").unionByName(vector.select("path", F.lit(0).alias("lexical_score"), "embedding_rank", "size_bytes"))
    g = both.groupBy("path").agg(F.max("lexical_score").alias("lexical_score"), F.min("embedding_rank").alias("embedding_rank"), F.max("size_bytes").alias("size_bytes"))
    return g.withColumn("relevance", P.relevance(F.col("lexical_score"), F.col("embedding_rank"), F.col("size_bytes")))


def _grams(c):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def tests_of(files: DataFrame, known: DataFrame, limit: int | None = 32) -> DataFrame:
    """(path, test_path, score): equal stems 40, a stem within 25, a path within 15; 20 for one folder, 10 for a tests
    folder; the best of each file, or all without a limit. A stem of three characters is contained only where all its trigrams are, so the containment join is an
    equi-join on that trigram of the stem which fewest tests have."""
    s = files.where(~P.is_test("path")).select("path", P.source_stem("path").alias("stem"), P.directory("path").alias("dir")).where(F.octet_length("stem") >= LEAST_STEM)
    t = known.where(P.is_test("path")).select(F.col("path").alias("test_path"), P.source_stem("path").alias("test_stem"), P.directory("path").alias("test_dir"), F.lower("path").alias("test_low"))
    t = t.withColumn("gram", F.explode(_grams(F.concat_ws("\n", "test_low", "test_stem"))))
    spread = t.groupBy("gram").agg(F.count("*").alias("tests"))
    rare = s.select("path", F.explode(_grams(F.col("stem"))).alias("gram")).join(spread, "gram", "left")
    rare = rare.groupBy("path").agg(F.min(F.struct(F.coalesce("tests", F.lit(0)).alias("tests"), F.col("gram"))).alias("r")).where("r.tests > 0").select("path", "r.gram")
    j = s.join(rare, "path").join(t, "gram").where(F.contains("test_low", F.col("stem")) | F.contains("test_stem", F.col("stem")))
    base = F.when(F.col("test_stem") == F.col("stem"), 40).when(F.contains("test_stem", F.col("stem")), 25).otherwise(15)
    score = base + F.when(F.col("dir") == F.col("test_dir"), 20).otherwise(0) + F.when(F.col("test_low").rlike("(^|/)tests/"), 10).otherwise(0)
    w = Window.partitionBy("path").orderBy(F.desc("score"), "test_path")
    found = j.select("path", "test_path", score.alias("score"))
    return found if limit is None else found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def inline_tests(symbols: DataFrame) -> DataFrame:
    """(path): files that hold a test module of their own."""
    return symbols.where((F.col("kind") == "module") & F.col("name").isin("test", "tests") & (F.col("language") == "rust")).select("path").distinct()


def affected_tests(files: DataFrame, known: DataFrame, stored: DataFrame, inline: DataFrame, limit: int = 5) -> DataFrame:
    """(task_id, test_path, score, reason) of the source files of tasks (task_id, path): stored mappings (path, test_path,
    score, reason) and those that are found anew, the best reason for each test; a file with tests of its own is one. Tests
    are looked for once a file, however many tasks have it."""
    paths = files.select("path").distinct()
    found = tests_of(paths, known).withColumn("reason", F.when(F.col("score") >= 40, "same stem").when(F.col("score") >= 25, "stem in test name").otherwise("stem in test path"))
    w = Window.partitionBy("path").orderBy(F.desc("score"), "test_path")
    kept = stored.join(paths, "path", "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= max(limit, 32)).drop("k")
    own = inline.join(paths, "path", "left_semi").select("path", F.col("path").alias("test_path"), F.lit(60).alias("score"), F.lit("tests inside").alias("reason"))
    both = kept.select("path", "test_path", F.col("score").cast("int").alias("score"), "reason").unionByName(found).unionByName(own)
    each = files.select("task_id", "path").distinct().join(both, "path").groupBy("task_id", "test_path").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("reason"))).alias("first"))
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "test_path")
    each = each.select("task_id", "test_path", (-F.col("first.less")).alias("score"), "first.reason")
    return each.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def first_best(tests: DataFrame) -> DataFrame:
    """Of (test_path, score, reason, place) the highest score, the one seen first on ties."""
    w = Window.partitionBy("test_path").orderBy(F.desc("score"), "place")
    return tests.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "place")


def best_per_path(tests: DataFrame) -> DataFrame:
    """Of (test_path, score, reason) the highest score, the smallest reason on ties."""
    w = Window.partitionBy("test_path").orderBy(F.desc("score"), "reason")
    return tests.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
