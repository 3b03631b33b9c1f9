"""The code index: built in full, refreshed for changed files, pruned; test mappings and embeddings that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import code, files, graph
from tessera.sources.scratch import keep

# Languages whose symbols are read, and the largest file that is.
LANGUAGES = ["rust", "python", "javascript", "typescript", "go", "java", "kotlin", "swift", "c", "cpp"]
MOST_BYTES = 1_000_000


def readable(sources: DataFrame) -> DataFrame:
    """Files (path, language, text) that symbols are read from."""
    return sources.where(F.col("language").isin(*LANGUAGES) & (F.octet_length("text") <= MOST_BYTES))


def full(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, references) of all files; both are read from tables, so what is built on them does not build them again."""
    s = readable(sources)
    symbols = keep(code.declarations(s), "symbols")
    return symbols, keep(code.references(s, symbols), "references")


def refresh(sources: DataFrame, changed: DataFrame, symbols: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, references) after some paths have changed: the changed files are read again, and they and the files that
    referred to them are searched for references anew, among all symbols. Rows of paths that are gone drop out. Without
    stored symbols everything is read."""
    if not symbols.head(1):
        return full(sources)
    s, live = readable(sources), sources.select("path").distinct()
    paths = changed.select("path").distinct()
    fresh = code.declarations(s.join(paths, "path", "left_semi"))
    kept = symbols.join(paths, "path", "left_anti").join(live, "path", "left_semi")
    all_ = keep(kept.select(fresh.columns).unionByName(fresh), "symbols")
    inbound = references.join(paths.withColumnRenamed("path", "target_path"), "target_path", "left_semi").select("path")
    scope = keep(paths.unionByName(inbound).distinct(), "scope")
    found = code.references(s.join(scope, "path", "left_semi"), all_)
    old = references.join(scope, "path", "left_anti").select(found.columns)
    return all_, graph.prune(old.unionByName(found), live, "path", "target_path").select(found.columns)


def delete_paths(rows: DataFrame, paths: DataFrame, column: str = "path") -> DataFrame:
    """A table without the rows of some paths."""
    from tessera.functions import paths as P

    gone = paths.select(P.normalised_path("path").alias(column)).distinct()
    return rows.join(gone, column, "left_anti").select(rows.columns)


def upsert_files(stored: DataFrame, found: DataFrame, at_ms: int) -> DataFrame:
    """Discovered files (path, language, size_bytes, discovered_at_ms, updated_at_ms) after a scan (path, language,
    size_bytes): what was known keeps the time of its discovery."""
    f = found.select("path", F.col("language").alias("l"), F.col("size_bytes").alias("s"), F.lit(True).alias("seen"))
    j, now = stored.join(f, "path", "full"), F.lit(at_ms).cast("long")
    pick = lambda new, old: F.when(F.col("seen"), F.col(new)).otherwise(F.col(old))
    return j.select("path", pick("l", "language").alias("language"), pick("s", "size_bytes").alias("size_bytes"), F.coalesce("discovered_at_ms", now).alias("discovered_at_ms"), F.when(F.col("seen"), now).otherwise(F.col("updated_at_ms")).alias("updated_at_ms"))


def refresh_tests(stored: DataFrame, known: DataFrame, changed: DataFrame) -> DataFrame:
    """Test mappings (path, test_path, score) after some paths have changed: theirs are found anew, and those of all files
    if a test is among them."""
    from tessera.functions import paths as P

    changed = changed.select("path").distinct()
    tests = changed.where(P.is_test("path")).agg((F.count("*") > 0).alias("all"))  # one row
    due = known.select("path").distinct().crossJoin(F.broadcast(tests)).join(changed.withColumn("hit", F.lit(True)), "path", "left").where("all or hit").select("path")
    found = files.tests_of(due, known)
    gone = stored.join(due, "path", "left_anti").join(known.select("path").distinct(), "path", "left_semi")
    return gone.select("path", "test_path", F.col("score").cast("int").alias("score")).unionByName(found.select("path", "test_path", F.col("score").cast("int").alias("score")))


def due_embeddings(inputs: DataFrame, stored: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Inputs (path, text) that are not stored yet (path, model, dimensions, content_key) as they are, with their key."""
    keyed = inputs.withColumns({"model": F.lit(model), "dimensions": F.lit(dimensions), "content_key": V.content_key("text")})
    return keyed.join(stored.select("path", "model", "dimensions", "content_key"), ["path", "model", "dimensions", "content_key"], "left_anti")
