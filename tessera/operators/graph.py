"""The code graph, one hop at a time: semi-joins of references with symbols, folds of their sites, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import files

# The narrowest cell of lines, and base scores by kind of neighbour.
CELL = 64
BASE = {"incoming_reference": 700, "outgoing_reference": 680, "path_reference": 640, "entity": 560, "edge": 540, "source": 520}


def incoming(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References to any of the symbols (by target_id)."""
    return references.join(symbols.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi")


def inside(references: DataFrame, ranges: DataFrame) -> DataFrame:
    """References that stand inside a symbol's lines: equal paths, the line within the range.

    A file's lines are cut into cells as wide as a range is long, by powers of two from ``CELL``: a range lies in two cells
    of its width at most, a line in one of each width. Different lines meet the ranges of their cell only, and references
    meet the lines that were found."""
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(CELL)).cast("double")))).cast("long")
    s = ranges.select("path", F.col("line_start").alias("lo"), F.coalesce("line_end", "line_start").alias("hi")).where("lo <= hi").distinct().withColumn("width", width)
    cell = lambda c: F.floor(F.col(c) / F.col("width"))
    cells = s.withColumn("cell", F.explode(F.array_distinct(F.array(cell("lo"), cell("hi")))))
    known = references.join(s.select("path").distinct(), "path", "left_semi")
    at = known.select("path", "line_start").distinct().join(s.select("path", "width").distinct(), "path").withColumn("cell", cell("line_start"))
    found = at.join(cells, ["path", "width", "cell"]).where(F.col("line_start").between(F.col("lo"), F.col("hi"))).select("path", "line_start").distinct()
    return references.join(found, ["path", "line_start"], "left_semi")


def collapse(neighbours: DataFrame) -> DataFrame:
    """One row a (kind, path, target): its sites, and the first line as the representative."""
    return neighbours.groupBy("kind", "path", "target_id").agg(F.count("*").alias("site_count"), F.min("line_start").alias("line_start"))


def most_connected(collapsed: DataFrame, a: str, b: str) -> DataFrame:
    """The node with most sites over both ends; the smallest name on ties."""
    ends = collapsed.select(F.explode(F.array(a, b)).alias("node"), F.greatest("site_count", F.lit(1)).alias("n"))
    return ends.groupBy("node").agg(F.sum("n").alias("sites")).orderBy(F.desc("sites"), "node").limit(1)


def fan_in(references: DataFrame) -> DataFrame:
    """(target_id, references, files): how many references, from how many files."""
    return references.groupBy("target_id").agg(F.count("*").alias("references"), F.countDistinct("path").alias("files"))


def neighbour_rank(neighbours: DataFrame, query: str, limit: int) -> DataFrame:
    """Adds rank to (kind, label, path, target_path, site_count): base by kind, 40 a matched term, 10 a site up to 6,
    less 120 within one file."""
    searchable = F.lower(F.concat_ws(" ", "kind", "label", "path"))
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), F.col("kind")), F.lit(500))
    score = base + X.contained(X.query_terms(F.lit(query)), searchable) * 40 + F.least("site_count", F.lit(6)) * 10
    score = F.greatest(score - F.when(F.col("path") == F.col("target_path"), 120).otherwise(0), F.lit(0))
    w = Window.orderBy(F.desc("score"), "kind", "label", "path")
    return neighbours.withColumn("score", score).orderBy(F.desc("score"), "kind", "label", "path").limit(limit).withColumn("rank", F.row_number().over(w))


def label_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Names of both ends; an end without an entity keeps its id."""
    n = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    j = edges.join(n("from_id"), "from_id", "left").join(n("to_id"), "to_id", "left")
    return j.select("id", "kind", F.coalesce("from_id_name", "from_id").alias("from_label"), F.coalesce("to_id_name", "to_id").alias("to_label"))


def impact(symbols: DataFrame, references: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, role): files that define, refer to, or are referred to by the targets (symbol_id)."""
    hit = symbols.join(targets, "symbol_id", "left_semi")
    into = incoming(references, hit).select(F.col("path").alias("file"), F.lit("incoming").alias("role"))
    out = inside(references, hit).join(symbols.select(F.col("symbol_id").alias("target_id"), F.col("path").alias("file")), "target_id").select("file", F.lit("outgoing").alias("role"))
    return hit.select(F.col("path").alias("file"), F.lit("defines").alias("role")).unionByName(into).unionByName(out).distinct()


def prune(stored: DataFrame, live: DataFrame, *path_columns: str) -> DataFrame:
    """Rows all of whose paths are still there."""
    out = stored
    for c in path_columns:
        out = out.join(live.select(F.col("path").alias(c)), c, "left_semi")
    return out


def replace_paths(stored: DataFrame, fresh: DataFrame, paths: DataFrame) -> DataFrame:
    """An index with the rows of some paths replaced."""
    return stored.join(paths.select("path"), "path", "left_anti").unionByName(fresh.join(paths.select("path"), "path", "left_semi"))


def of_targets(symbols: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """The symbols that each target (target_id, target) names, by path or by name, the first ``limit`` in order, with rank.
    A target that names none has no rows: the caller recalls by words then."""
    by = lambda c: symbols.join(targets, symbols[c] == F.col("target"))
    w = Window.partitionBy("target_id").orderBy("path", "line_start", "name")
    both = by("path").unionByName(by("name").where("path <> target"))
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def of_path(references: DataFrame, path: str, limit: int) -> DataFrame:
    """The references of one file in order."""
    return references.where(F.col("path") == path).orderBy("line_start", "target_path", "target_name", "kind").limit(limit)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("value")).distinct()


def impact_report(symbols: DataFrame, references: DataFrame, targets: DataFrame, known: DataFrame) -> DataFrame:
    """One row of what hangs on some symbols (path, name, line_start, line_end): references to and from them (with
    target_path, target_name), the files of all these, and the tests of those files."""
    t = targets.select("path", "name", "line_start", "line_end").distinct()
    into = references.join(t.select(F.col("path").alias("target_path"), F.col("name").alias("target_name")).distinct(), ["target_path", "target_name"], "left_semi")
    out = inside(references, t)
    ends = lambda d: d.select(F.explode(F.array("path", "target_path")).alias("path"))
    affected = t.select("path").unionByName(ends(into)).unionByName(ends(out)).distinct()
    tests = files.tests_of(affected, known, None)  # all of them are counted
    count = lambda d, name: d.agg(F.count("*").alias(name))
    parts = [count(targets, "symbols"), count(into, "inbound"), count(out, "outbound"), affected.agg(F.count("*").alias("files"), F.min("path").alias("first_file"), F.max("path").alias("last_file")), tests.agg(F.countDistinct("test_path").alias("tests"))]
    report = parts[0]
    for p in parts[1:]:
        report = report.crossJoin(F.broadcast(p))  # one row each
    return report
