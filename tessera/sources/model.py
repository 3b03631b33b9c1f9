"""The model's relations over stored tables. Every reader prunes to the columns that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts: id, created_at_ms, kind, text, confidence, valid_to, superseded_by. A tenth is retired."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    retired = F.when(F.col("doc_id") % 10 == 0, (F.col("doc_id") * 1000 + 500).cast("string"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") * 1000).alias("created_at_ms"),
        F.col("source").alias("kind"),
        "text",
        F.when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("confidence"),
        retired.alias("valid_to"),
        F.lit(None).cast("long").alias("superseded_by"),
    )


def active(memories: DataFrame) -> DataFrame:
    """A fact holds as long as it has no end."""
    return memories.where("valid_to is null")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query)."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, (task_id, task): each item of the benchmark with the names of a part and a supplier."""
    item = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), "text")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), "p_name")
    return item.join(part, "task_id").select("task_id", F.concat("text", F.lit(" in "), "p_name", F.lit(" for user supplier_"), F.col("task_id").cast("string")).alias("task"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code symbols: path, name, kind, line_start, line_end, signature."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.select(
        F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".rs")).alias("path"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("kind"),
        F.col("p_partkey").alias("line_start"),
        (F.col("p_partkey") + F.col("p_size")).alias("line_end"),
        F.concat(F.lit("fn "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), F.lower("p_type"), F.lit(")")).alias("signature"),
        F.col("p_partkey").alias("symbol_id"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code references: path, line_start, target_id, kind."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return line.select(
        F.concat(F.lit("src/supplier_"), F.col("l_suppkey").cast("string"), F.lit(".rs")).alias("path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_start"),
        F.col("l_partkey").alias("target_id"),
        F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "import").otherwise("reference").alias("kind"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered files: path, size_bytes, language."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("size_bytes"))
    path = F.concat(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, "_test.py").when(F.col("page_id") % 3 == 1, ".rs").otherwise(".md"))
    return p.select(path.alias("path"), F.col("size_bytes").cast("long").alias("size_bytes")).withColumn("language", paths.language("path"))


def files_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered files with a number: id, path, language."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    path = F.concat(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.when(F.col("id") % 3 == 0, "_test.py").when(F.col("id") % 3 == 1, ".rs").otherwise(".md"))
    return p.select("id", path.alias("path")).withColumn("language", paths.language("path"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events: session_id, seq, kind, detail."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("kind"), F.col("text").alias("detail"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: the first user turn is the task, the last assistant turn the summary; some are open or promoted."""
    e = session_events(spark, sf_dir)
    g = e.groupBy("session_id").agg(
        F.min_by("detail", F.when(F.col("kind") == "user", F.col("seq"))).alias("task"),
        F.max_by("detail", F.when(F.col("kind") == "assistant", F.col("seq"))).alias("summary"),
        F.count("*").alias("n_events"),
    )
    start = F.col("session_id") * 60_000
    return g.select(
        "session_id",
        "task",
        start.alias("started_at_ms"),
        F.when(F.col("session_id") % 7 != 0, start + F.col("n_events") * 1000).alias("ended_at_ms"),
        F.when(F.col("session_id") % 7 != 0, F.col("summary")).alias("final_summary"),
        (F.col("session_id") % 5 == 0).alias("promoted"),
    )


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics: id, path, severity, message, created_at_ms."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("src/user_"), F.col("user_id").cast("string"), F.lit(".rs")).alias("path"),
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning").otherwise("note").alias("severity"),
        F.concat(F.col("event_type"), F.lit(" while handling user "), F.col("user_id").cast("string")).alias("message"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at_ms"),
    )


PER_FILE, BLOCK = 40, 5  # functions of a source file, lines of a function
# Parameter lists and bodies of the functions, by remainders of the part's size.
PARAMETERS = ["()", "(a: u32)", "(a: u32, b: Vec<u8>)", "(a: Map<K, V>, b: (u8, u8), c: [u8; 2])"]
BODIES = [("    if a > 1 && b { while c || d { match e {", "    } } }"), ("    if a > 1 {", "    }"), ("    loop {", "    }")]


def source_path(key: Column) -> Column:
    return F.concat(F.lit("src/mod_"), F.floor(key / PER_FILE).cast("string"), F.lit(".rs"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of source text, (path, line, text): a function a part, each calling that of the next part."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"), "p_size")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("name").alias("next"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("p_size") % by + 1).cast("int"))
    head = F.concat(F.when(F.col("p_partkey") % 2 == 0, "pub ").otherwise(""), F.lit("fn "), F.col("name"), pick(PARAMETERS, 4), F.lit(" {"))
    call = F.concat(F.lit("        let total = "), F.coalesce("next", F.lit("done")), F.lit("(a);"))
    texts = F.array(head, pick([a for a, _ in BODIES], 3), call, pick([z for _, z in BODIES], 3), F.lit("}"))
    rows = p.join(after, "p_partkey", "left").select(source_path(F.col("p_partkey")).alias("path"), (F.col("p_partkey") % PER_FILE * BLOCK + 1).alias("first"), F.posexplode(texts).alias("i", "text"))
    return rows.select("path", (F.col("first") + F.col("i")).alias("line"), "text")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: path, language, text. A file has forty functions."""
    g = source_lines(spark, sf_dir).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    return g.select("path", F.lit("rust").alias("language"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved references: path, line_start, target_path, target_name, target_kind, kind, excerpt. From files of suppliers,
    and, for the first line of each order, from within the file of the part itself."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    s = symbols(spark, sf_dir)
    own = s.select(F.col("symbol_id").alias("l_partkey"), F.col("path").alias("own_path"))
    target = s.select(F.col("symbol_id").alias("target"), F.col("path").alias("target_path"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"))
    first = F.col("l_linenumber") == 1
    j = line.withColumn("target", F.when(first, F.col("l_orderkey") % 100).otherwise(F.col("l_partkey"))).join(own, "l_partkey").join(target, "target")
    return j.select(
        F.when(first, F.col("own_path")).otherwise(F.concat(F.lit("src/supplier_"), F.col("l_suppkey").cast("string"), F.lit(".rs"))).alias("path"),
        F.when(first, F.col("l_partkey") + F.col("l_orderkey") % 5).otherwise(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_start"),
        "target_path", "target_name", "target_kind",
        F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "import").otherwise("reference").alias("kind"),
        F.when(F.col("l_returnflag") == "A", F.concat("target_name", F.lit("();"))).otherwise("").alias("excerpt"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the graph: id, kind, name, locator, created_at_ms."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("src/user_"), F.col("n_nationkey").cast("string"), F.lit(".rs"))).alias("locator"), (F.col("n_nationkey").cast("long") * 1000).alias("created_at_ms"))
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("locator"), (F.col("r_regionkey").cast("long") * 1000).alias("created_at_ms"))
    return n.unionByName(r)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph: id, from_id, to_id, kind, created_at_ms."""
    n = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    return n.select(F.concat(F.lit("e"), key).alias("id"), F.concat(F.lit("n"), key).alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to_id"), F.lit("in").alias("kind"), (F.col("n_nationkey").cast("long") * 1000).alias("created_at_ms"))


def record_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded sources: id, kind, locator, created_at_ms."""
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    return s.select(F.concat(F.lit("s"), key).alias("id"), F.lit("file").alias("kind"), F.concat(F.lit("src/supplier_"), key, F.lit(".rs")).alias("locator"), (F.col("s_suppkey") * 1000).alias("created_at_ms"))


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sessions told of edits, (detail, at): paths as words, in quotes, and as part of a longer one."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("pkg/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".go")).alias("path"))
    k = F.col("s_suppkey") % 3
    told = F.when(k == 0, F.concat("path", F.lit(" again"))).when(k == 1, F.concat(F.lit('"./'), "path", F.lit('"+x'))).otherwise(F.concat(F.lit("copy of("), "path", F.lit(".bak)")))
    return s.select(F.concat(F.lit("edited "), told).alias("detail"), (F.col("s_suppkey") * 200_000).alias("at"))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines of a worktree, (code, rest), as git writes them."""
    k = F.col("n_nationkey")
    path = F.concat(F.lit("src/brand_"), k.cast("string"), F.lit(".rs"))
    code = F.element_at(F.array(*map(F.lit, ["M ", " M", "??", "R ", "UU", "D "])), (k % 6 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(code.alias("code"), F.when(k % 6 == 3, F.concat(F.lit("src/old_"), k.cast("string"), F.lit(".rs -> "), path)).otherwise(path).alias("rest"))


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit log as lines, (line, text): a header an order, then a file a line of it."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    word = F.element_at(F.array(*map(F.lit, ["feat(user_{0}): rank supplier", "fix: broken supplier {0}", "plain subject line {0}", "docs(readme)!: say more", "wip"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    head = o.select((F.col("o_orderkey") * 10).alias("line"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string"), F.lit("\x1f"), F.replace(word, F.lit("{0}"), (F.col("o_custkey") % 10).cast("string"))).alias("text"))
    f = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.concat(F.lit("src/supplier_"), (F.col("l_suppkey") % 40).cast("string"), F.when(F.col("l_linenumber") % 4 == 3, ".md").otherwise(".rs")).alias("text"))
    return head.unionByName(f)


def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a project, (path): sources and tests in the ways that languages have of naming them."""
    key = F.col("k").cast("string")
    made = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    b = read(spark, sf_dir, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).alias("k")).distinct()
    n = F.col("k").cast("int")
    from_brand = b.select(F.explode(F.array_compact(F.array(
        made("src/brand_", key, ".rs"), F.when(n % 2 == 0, made("tests/brand_", key, ".rs")), made("src/Brand", key, "Order.java"), F.when(n % 3 == 0, made("src/Brand", key, "OrderTest.java")),
        made("./web\\brand_", key, ".ts"), F.when(n % 5 == 0, made("web/brand_", key, ".test.ts")), F.when(n % 7 == 0, made("vendor/brand_", key, "/spec_helper.rb")),
    ))).alias("path"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    n = F.col("k")
    from_supplier = s.select(F.explode(F.array_compact(F.array(
        made("pkg/supplier_", key, ".go"), F.when(n % 3 == 0, made("pkg/supplier_", key, "_test.go")), F.when(n % 5 == 0, made("pkg/supplier_", key, "_retry_test.go")),
        F.when(n % 4 == 0, made("docs/supplier_", key, ".md")), F.when(n % 11 == 0, made("conf/supplier_", key, ".yml")),
    ))).alias("path"))
    return from_brand.unionByName(from_supplier)


# Statements about nations, of which some oppose each other.
STATEMENTS = [
    "{0} exports are enabled for every port", "{0} exports are disabled for every port", "cargo for {0} leaves after the storm season", "cargo for {0} leaves before the storm season",
    "the {0} customs flag is true on weekdays", "the {0} customs flag is false on weekdays", "{0} permits are allowed when a seal is present", "{0} permits are denied when a seal is absent",
    "ledgers of {0} are kept in books", "Ledgers of  {0} are\tkept in books",
]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short facts, (id, created_at_ms, text): each statement about each nation."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.posexplode(F.array(*map(F.lit, STATEMENTS))).alias("i", "t"))
    key = F.col("n_nationkey").cast("long") * 100 + F.col("i")
    return n.select(key.alias("id"), (F.col("i") * 10 + F.col("n_nationkey") % 3).cast("long").alias("created_at_ms"), F.replace("t", F.lit("{0}"), F.lower("n_name")).alias("text"))
