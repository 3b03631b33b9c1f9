"""Registered queries of fact and session life, indexing, replication and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import evaluation, files, graph, indexing, lifecycle, recall, replication, sync
from tessera.plans.context import _once as once
from tessera.plans.graph import _ISTEST, _LINK, _STEM, _SYM, _WORDS
from tessera.plans.recall import _COS, terms
from tessera.plans.recall import ORACLES as RECALL
from tessera.plans.source import _CL, _FN, _PP, _ST, LIKELY, _log
from tessera.plans.source import ORACLES as SOURCE
from tessera.plans.store import _ORD, _SES, _SUM, _orders, _summary
from tessera.sources import model as M

WANTED, MOST_FILES, N_FILES, N_SYMBOLS = 30, 8, 12, 8


def maintenance_report(spark, d):
    s = M.statements(spark, d).withColumn("valid_to", F.when(F.col("id") % 7 == 0, "1"))
    return lifecycle.maintenance(s)


def _writes(spark, d):
    k = F.col("doc_id")
    return M.read(spark, d, "documents").select(
        k.alias("id"), "text", F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 2.0).otherwise(1.0).alias("confidence"), F.lit("private-1").alias("sensitivity"), F.when(k % 2 == 0, "file").alias("source_kind"),
        F.when(k % 2 == 0, F.concat(F.lit("src/d"), k.cast("string"), F.lit(".rs"))).alias("source_locator"), F.when(k % 5 == 0, "2024").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
    )


def remembered(spark, d):
    facts, _ = lifecycle.remember(_writes(spark, d), "global", 99)
    return facts.select("id", "created_at_ms", "kind", F.md5(F.col("text").cast("binary")).alias("text"), "confidence", "scope", "structured_payload")


def refused_writes(spark, d):
    return lifecycle.remember(_writes(spark, d))[1].groupBy("problem").agg(F.count("*").alias("n"))


def promoted_sessions(spark, d):
    p = lifecycle.promotions(M.sessions(spark, d), M.session_events(spark, d), 123, 3)
    return p.select("session_id", F.md5(F.col("text").cast("binary")).alias("text"), "structured_payload", F.col("fact_count").cast("long").alias("fact_count"))


def promotion_memory(spark, d):
    s = M.sessions(spark, d)
    k = F.col("session_id")
    rows = s.where(k % 2 == 0).select(k, F.concat(F.lit("m"), k.cast("string")).alias("memory_id"))
    told = F.concat(F.lit('{"source":{"type":"'), F.when(k % 3 == 0, "session").otherwise("manual"), F.lit('","session_id":"'), k.cast("string"), F.lit('"}}'))
    memories = s.where(k % 5 != 0).select(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.when(k % 11 == 0, "no json").otherwise(told).alias("structured_payload"))
    return lifecycle.promoted(s, rows, memories)


def payload_sessions(spark, d):
    s = M.sessions(spark, d).select("session_id", F.concat(F.lit('{"source":{"type":"session","session_id":"'), (F.col("session_id") - F.col("session_id") % 2).cast("string"), F.lit('"}}')).alias("p"))
    return s.select("session_id", lifecycle.from_session(F.when(F.col("session_id") % 3 == 0, "{").otherwise(F.col("p")), "session_id").alias("told"))


def vector_files(spark, d):
    v = M.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    attributes = M.files_by_id(spark, d)
    return recall.vector_files(recall.vector_top(v, q, 10), attributes).select("query_id", "id", "vector_rank", "path", "language")


def recall_scopes(spark, d):
    docs = M.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") * 1000).alias("created_at_ms"))
    q = M.query_set(spark, d)
    project = docs.where("id % 3 <> 0")
    return recall.scopes(recall.blend(project, q, recall.bm25(project, q)), recall.blend(docs, q, recall.bm25(docs, q)), 5, 3)


def target_symbols(spark, d):
    s = M.symbols(spark, d)
    targets = M.read(spark, d, "nation").select(F.col("n_nationkey").alias("target_id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("src/brand_"), F.col("n_nationkey").cast("string"), F.lit(".rs"))).when(F.col("n_nationkey") % 3 == 0, "cold_widget").otherwise("nothing_of_that_name").alias("target"))
    return graph.of_targets(s, targets, 5).select("target_id", "symbol_id", "rank")


def impact_report(spark, d):
    s = M.symbols(spark, d)
    t = s.where("name = 'cold_widget'")
    return graph.impact_report(s, M.code_links(spark, d), t, M.project_paths(spark, d))


def path_references(spark, d):
    return graph.of_path(M.code_links(spark, d), "src/brand_13.rs", 40).select("line_start", "target_path", "target_name", "kind")


def known_paths(spark, d):
    return graph.distinct_values(M.code_links(spark, d), "target_path")


def first_best_tests(spark, d):
    rows = M.read(spark, d, "lineitem").select((F.col("l_suppkey") % 40).cast("string").alias("test_path"), F.floor("l_quantity").cast("long").alias("score"), F.col("l_returnflag").alias("reason"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return files.first_best(rows)


def padded_vectors(spark, d):
    v = M.read(spark, d, "embeddings").select("vec_id", V.pad("embedding", 1536).alias("v"), V.pad("embedding", 7).alias("w"))
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.size("w").alias("cut"), F.round(F.element_at("w", 7).cast("double"), 4).alias("last"))


def index_full(spark, d):
    symbols, references = indexing.full(M.source_files(spark, d))
    return symbols.groupBy("path").agg(F.count("*").alias("symbols")).join(references.groupBy("path").agg(F.count("*").alias("references")), "path", "left").fillna(0)


def _after_change(spark, d):
    """Source files after the functions of every third file got new names and every fifth file went."""
    number = F.regexp_extract("path", "[0-9]+", 0).cast("int")
    f = M.source_files(spark, d).where(number % 5 != 4)
    changed = number % 3 == 1
    return f.withColumn("text", F.when(changed, F.regexp_replace("text", r"fn (\w+)", "fn new_$1")).otherwise(F.col("text"))), changed


def index_incremental(spark, d):
    symbols, references = indexing.full(M.source_files(spark, d))
    now, changed = _after_change(spark, d)
    s, r = indexing.refresh(now, now.where(changed).select("path"), symbols, references)
    told = s.select("path", "name", F.lit("symbol").alias("what")).unionByName(r.select("path", F.col("target_name").alias("name"), F.lit("reference").alias("what")))
    return told.groupBy("path", "what").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


def file_upsert(spark, d):
    p = M.project_paths(spark, d).withColumn("size_bytes", F.length("path").cast("long"))
    stored = p.where("size_bytes % 3 <> 0").select("path", F.lit("old").alias("language"), "size_bytes", F.lit(10).cast("long").alias("discovered_at_ms"), F.lit(11).cast("long").alias("updated_at_ms"))
    return indexing.upsert_files(stored, p.where("size_bytes % 2 = 0").select("path", F.lit("new").alias("language"), (F.col("size_bytes") + 1).alias("size_bytes")), 77)


def test_refresh(spark, d):
    p = M.project_paths(spark, d)
    stored = p.where("path like 'src/brand%'").select("path", F.lit("tests/old.rs").alias("test_path"), F.lit(1).alias("score"))
    return indexing.refresh_tests(stored, p, p.where("path like 'src/Brand%Order.java'").select("path")).select("path", "test_path", F.col("score").cast("long").alias("score"))


def due_embeddings(spark, d):
    q = M.query_set(spark, d).select(F.col("query_id").cast("string").alias("path"), F.col("query").alias("text"))
    k = F.col("path").cast("int")
    stored = q.where(k % 3 != 0).select("path", F.lit("m1").alias("model"), F.when(k % 3 == 1, 64).otherwise(32).alias("dimensions"), F.when(k % 6 == 1, V.content_key("text")).otherwise("0").alias("content_key"))
    return indexing.due_embeddings(q, stored, "m1", 64).select("path", "content_key")


def deleted_paths(spark, d):
    gone = M.project_paths(spark, d).where("path like '%supplier%7%'").select(F.concat(F.lit("./"), "path").alias("path"))
    return indexing.delete_paths(M.project_paths(spark, d), gone)


def sync_plan(spark, d):
    s = M.sessions(spark, d).select(F.col("session_id").cast("string").alias("id"), "final_summary")
    tables = {"memories": M.memories(spark, d), "sessions": s, "diagnostics": M.diagnostics(spark, d), "entities": M.entities(spark, d), "edges": M.edges(spark, d), "code_symbols": M.symbols(spark, d), "session_events": M.session_events(spark, d)}
    return replication.plan(tables, replication.classes("memories, edges,session-summaries,entities,secrets"))


def _sources(spark, d):
    s = M.record_sources(spark, d)
    return s.where("created_at_ms % 3000 <> 0"), s.where("created_at_ms % 2000 <> 0").withColumn("kind", F.lit("other"))


def sync_run(spark, d):
    here, there = _sources(spark, d)
    e = M.entities(spark, d)
    local, remote = {"sources": here, "entities": e}, {"sources": there, "entities": e.where("kind = 'nation'")}
    config = replication.Config("hybrid", classes=["sources", "entities"])
    pushed, pulled = (replication.run(o, local, remote, config).withColumn("operation", F.lit(o)) for o in ("push", "pull"))
    return pushed.unionByName(pulled)


def sync_payload(spark, d):
    """Records of one side, encoded, decoded and pulled."""
    here, there = _sources(spark, d)
    return replication.pull("sources", here, replication.decode("sources", replication.encode("sources", there)))


def sync_events(spark, d):
    k = F.col("session_id")
    s = M.sessions(spark, d).where(k % 4 != 0).select(k.cast("string").alias("id"))
    e = M.session_events(spark, d).select(F.concat(k.cast("string"), F.lit("-"), F.col("seq").cast("string")).alias("id"), k.cast("string").alias("session_id"), "kind", "detail", F.col("seq").alias("created_at_ms"))
    rows, refused = replication.accepted("session_events", e, s)
    return rows.agg(F.lit("accepted").alias("reason"), F.count("*").alias("n")).unionByName(refused)


def sync_history(spark, d):
    n = M.read(spark, d, "nation")
    runs = n.select(F.col("n_nationkey").cast("string").alias("id"), F.lit("push").alias("operation"), F.lit("ok").alias("status"), (F.col("n_regionkey") * 1000).cast("long").alias("started_at_ms"))
    t = n.select(F.col("n_nationkey").cast("string").alias("run_id"), F.explode(F.array(F.lit("sources"), F.lit("edges"))).alias("table"), F.col("n_nationkey").cast("long").alias("inserted"), F.lit(1).cast("long").alias("updated"))
    c = t.where("inserted % 2 = 0 and table = 'edges'").select("run_id", "table", F.lit("local_row_preserved").alias("reason"), F.col("inserted").alias("n"))
    h = replication.history(runs, t, c, 10)
    text = lambda x: F.concat(x["table"], F.lit(":"), x["inserted"].cast("string"), F.coalesce(F.concat(F.lit(":"), x["conflicts"][0]["n"].cast("string")), F.lit("")))
    return h.select("id", "started_at_ms", F.array_join(F.transform("tables", text), ",").alias("tables"))


def sync_pull_summary(spark, d):
    local, remote = _orders(spark, d)
    return _summary(sync.pull_newer(local, replication_rows(remote), "o_orderkey", "updated_at"))


def replication_rows(rows):
    """Through JSON and back."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("r")).select(F.from_json("r", rows.schema).alias("r")).select("r.*")


def _cases(spark, d):
    c = _log(spark, d).withColumn("place", -F.substring("hash", 2, 20).cast("long"))
    there = M.record_sources(spark, d).where("created_at_ms % 3000 <> 2000").select(F.col("locator").alias("path"), F.col("created_at_ms").alias("size_bytes"))
    return *evaluation.cases(c, there, WANTED, MOST_FILES), there


def eval_skips(spark, d):
    return _cases(spark, d)[1]


def eval_replay(spark, d):
    cases, _, there = _cases(spark, d)
    name = F.regexp_replace("locator", r"^src/(.*)\.rs$", "rank_$1")
    s = M.record_sources(spark, d).select(F.col("locator").alias("path"), name.alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("fn "), name, F.lit("()")).alias("signature"), F.lit(1).cast("long").alias("line_start"))
    return evaluation.replay(cases, there, s, N_FILES, N_SYMBOLS)


def eval_means(spark, d):
    return evaluation.means(eval_replay(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        maintenance_report, remembered, refused_writes, promoted_sessions, promotion_memory, payload_sessions, vector_files, recall_scopes, target_symbols, impact_report, path_references, known_paths, first_best_tests,
        padded_vectors, index_full, index_incremental, file_upsert, test_refresh, due_embeddings, deleted_paths, sync_plan, sync_run, sync_payload, sync_events, sync_history, sync_pull_summary, eval_skips, eval_replay, eval_means,
    )
}

_WR = "wr AS (SELECT doc_id AS id, trim(text) AS text, CASE doc_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END AS c FROM documents)"
_SRC = "s AS (SELECT 's' || s_suppkey AS id, 'file' AS kind, 'src/supplier_' || s_suppkey || '.rs' AS locator, s_suppkey * 1000 AS created_at_ms FROM supplier), l AS (SELECT * FROM s WHERE created_at_ms % 3000 <> 0), r AS (SELECT id, 'other' AS kind, locator, created_at_ms FROM s WHERE created_at_ms % 2000 <> 0)"
_EX = "ex AS (SELECT 'src/supplier_' || s_suppkey || '.rs' AS path, s_suppkey * 1000 AS size_bytes, s_suppkey FROM supplier WHERE s_suppkey % 3 <> 2)"
_SEL = r"list_filter(regexp_split_to_array(lower(task), '[^\p{L}\p{N}_-]+'), lambda t: strlen(t) > 2)"
_CASES = (
    f"{_CL}, {_EX}, gc AS (SELECT cl.k, hash, task, list_sort(coalesce(list(path) FILTER (path IN (SELECT path FROM ex) AND {LIKELY}), [])) AS expected FROM cl LEFT JOIN cf USING (k) GROUP BY cl.k, hash, task), "
    f"rs AS (SELECT *, CASE WHEN len({_SEL}) < 2 THEN 'short_subject' WHEN len(expected) = 0 THEN 'no_source_files' WHEN len(expected) > {MOST_FILES} THEN 'too_many_files' END AS reason FROM gc), ok AS (SELECT *, {_SEL} AS ts FROM rs WHERE reason IS NULL ORDER BY k DESC LIMIT {WANTED})"
)
_REPLAY = (
    f"{_CASES}, f1 AS (SELECT hash, path, size_bytes, list_sum(list_transform(ts, lambda t: CASE WHEN split_part(regexp_extract(path, '[^/]*$'), '.', 1) = t THEN 8 WHEN contains(regexp_extract(path, '[^/]*$'), t) THEN 4 WHEN contains(path, t) THEN 2 ELSE 0 END + CASE WHEN t = 'rust' THEN 3 ELSE 0 END)) AS lex FROM ok, ex), "
    f"ca AS (SELECT * FROM f1 WHERE lex > 0 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY lex * 20 + CASE WHEN size_bytes <= 128000 THEN 10 ELSE 0 END DESC, path) <= {N_FILES}), "
    "sy AS (SELECT 'src/supplier_' || s_suppkey || '.rs' AS path, 'rank_supplier_' || s_suppkey AS name, 'function' AS kind, 'fn rank_supplier_' || s_suppkey || '()' AS signature FROM supplier), "
    f"sq AS (SELECT hash, path, ts, task, name, signature, kind, {_WORDS} AS ws FROM ok, sy), "
    "sr AS (SELECT *, list_sum(list_transform(ts, lambda t: CASE WHEN name = t THEN 10 WHEN list_contains(ws, t) THEN 7 WHEN len(list_filter(ws, lambda w: (starts_with(w, t) OR starts_with(t, w)) AND least(strlen(w), strlen(t)) >= 4 AND abs(strlen(w) - strlen(t)) <= 3)) > 0 THEN 6 WHEN contains(name, t) THEN 5 ELSE 0 END + CASE WHEN kind = t THEN 3 ELSE 0 END + CASE WHEN contains(path, t) THEN 2 ELSE 0 END + CASE WHEN contains(signature, t) THEN 1 ELSE 0 END)) AS b FROM sq), "
    f"sx AS (SELECT DISTINCT hash, path FROM (SELECT *, b + CASE WHEN b > 0 THEN 2 ELSE 0 END + CASE WHEN name = lower(task) OR contains(signature, lower(task)) THEN 12 ELSE 0 END AS score FROM sr) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY score DESC, path) <= {N_SYMBOLS}), "
    "pk AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY (coalesce(lex, 0) + CASE WHEN sx.path IS NULL THEN 0 ELSE 6 END) * 20 + CASE WHEN size_bytes <= 128000 THEN 10 ELSE 0 END DESC, path) AS rank FROM ca FULL JOIN sx USING (hash, path)), "
    "pl AS (SELECT hash, list(path) AS ps FROM pk GROUP BY hash), sc AS (SELECT hash, round(len(list_filter(expected, lambda p: list_contains(coalesce(ps, []), p))) / len(expected), 6) AS recall, (SELECT min(rank) FROM pk WHERE pk.hash = ok.hash AND list_contains(expected, pk.path)) AS first_hit_rank, "
    "EXISTS (SELECT 1 FROM sx WHERE sx.hash = ok.hash AND list_contains(expected, sx.path)) AS symbol_hit, EXISTS (SELECT 1 FROM ca WHERE ca.hash = ok.hash AND list_contains(expected, ca.path)) AS candidate_hit, len(list_filter(ts, lambda t: len(list_filter(expected, lambda p: contains(lower(p), t))) > 0)) > 0 AS retrievable FROM ok LEFT JOIN pl USING (hash))"
)


def _blend(name: str, where: str) -> str:
    """Ranked recall of all benchmark items over some documents."""
    tok = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_-]+'), lambda t: t <> '')"
    return (
        f"{name}d AS (SELECT doc_id AS id, text, {tok} AS toks FROM documents WHERE {where}), {name}st AS (SELECT count(*) AS n, avg(len(toks)) AS average FROM {name}d), {name}p AS (SELECT id, len AS length, term, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM {name}d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), "
        f"{name}df AS (SELECT term, count(*) AS df FROM {name}p GROUP BY term), {name}sc AS (SELECT query_id, p.id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS bm25 FROM q JOIN {name}p p USING (term) JOIN {name}df USING (term), {name}st GROUP BY query_id, p.id), "
        f"{name}f AS (SELECT * FROM {name}sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) <= 50), "
        f"{name}b AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM (SELECT query_id, f.id, round(10.0 * (CASE WHEN contains(lower(d.text), lower(b.text)) THEN 10 ELSE 0 END + len(list_filter({terms('b.text')}, lambda t: contains(lower(d.text), t)))) + 1 / (1 + abs(bm25)), 6) AS score FROM {name}f f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id))"
    )


_T = "t AS (SELECT * FROM sym WHERE name = 'cold_widget')"
_OUT = "EXISTS (SELECT 1 FROM t WHERE t.path = lk.path AND lk.line_start BETWEEN t.line_start AND t.line_end)"
_IN = "EXISTS (SELECT 1 FROM t WHERE t.path = lk.target_path AND t.name = lk.target_name)"
_TM = SOURCE["test_map"]
_CONTRA = SOURCE["contradictions"].replace("SELECT * FROM st)", "SELECT * FROM st WHERE id % 7 <> 0)")
ORACLES = {
    "maintenance_report": f"WITH {_ST}, n AS (SELECT lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t, count(*) AS c FROM st WHERE id % 7 <> 0 GROUP BY 1 HAVING count(*) > 1) SELECT (SELECT count(*) FROM st) AS facts, (SELECT count(*) FROM st WHERE id % 7 <> 0) AS active, (SELECT count(*) FROM n) AS groups, (SELECT sum(c)::BIGINT FROM n) AS copies, (SELECT count(*) FROM ({_CONTRA})) AS conflicts",
    "remembered": f"WITH {_WR} SELECT id, 99::BIGINT AS created_at_ms, 'fact' AS kind, md5(text) AS text, c AS confidence, 'global' AS scope, '{{\"scope\":\"global\"' || CASE WHEN id % 2 = 0 THEN ',\"source\":{{\"type\":\"manual\",\"kind\":\"file\",\"locator\":\"src/d' || id || '.rs\"}}' ELSE '' END || ',\"metadata\":{{\"confidence\":' || CASE WHEN id % 3 = 0 THEN '0.5' ELSE '1.0' END || ',\"sensitivity\":\"private-1\"' || CASE WHEN id % 5 = 0 THEN ',\"validity\":{{\"valid_from\":\"2024\"}}' ELSE '' END || '}}}}' AS structured_payload FROM wr WHERE text <> '' AND id % 3 <> 1",
    "refused_writes": f"WITH {_WR} SELECT CASE WHEN text = '' THEN 'empty_text' ELSE 'confidence' END AS problem, count(*) AS n FROM wr WHERE text = '' OR id % 3 = 1 GROUP BY 1",
    "promoted_sessions": f"WITH {_SES}, due AS (SELECT * FROM se WHERE ended_at_ms IS NOT NULL AND NOT promoted AND (final_summary IS NOT NULL OR EXISTS (SELECT 1 FROM ev WHERE ev.session_id = se.session_id))), e AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, kind, detail) AS n, CASE WHEN starts_with(detail, kind || ':') THEN detail ELSE kind || ': ' || detail END AS t FROM ev), "
    "u AS (SELECT * FROM e WHERE n <= 3 UNION ALL SELECT session_id, 4, CASE WHEN starts_with(final_summary, 'summary:') THEN final_summary ELSE 'summary: ' || final_summary END FROM due WHERE final_summary IS NOT NULL), g AS (SELECT session_id, string_agg(t, '; ' ORDER BY n) AS text, count(*) AS k FROM u GROUP BY 1) "
    "SELECT session_id, md5('Findings of the session ''' || coalesce(task, '') || ''': ' || text) AS text, '{\"source\":{\"type\":\"session\",\"session_id\":\"' || session_id || '\",\"fact_count\":' || k || '}}' AS structured_payload, k AS fact_count FROM due JOIN g USING (session_id)",
    "promotion_memory": f"WITH {_SES} SELECT session_id, 'm' || session_id AS memory_id FROM se WHERE session_id % 5 <> 0 AND (session_id % 2 = 0 OR (session_id % 3 = 0 AND session_id % 11 <> 0))",
    "payload_sessions": f"WITH {_SES} SELECT session_id, session_id % 3 <> 0 AND session_id % 2 = 0 AS told FROM se",
    "vector_files": f"WITH {_COS}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.u, b.u), 6) AS score FROM u a, u b WHERE a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS vector_rank FROM s), fl AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || CASE page_id % 3 WHEN 0 THEN '_test.py' WHEN 1 THEN '.rs' ELSE '.md' END AS path, CASE page_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'markdown' END AS language FROM pages) SELECT query_id, id, vector_rank, path, language FROM r LEFT JOIN fl ON page_id = id WHERE vector_rank <= 10",
    "recall_scopes": f"WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({terms('text')})) AS term FROM benchmark), {_blend('p', 'doc_id % 3 <> 0')}, {_blend('g', 'true')}, a AS (SELECT query_id, id, score, 'project' AS scope, rank FROM pb WHERE rank <= 5), b AS (SELECT query_id, id, score, 'global' AS scope, rank FROM gb WHERE rank <= 3) SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.id = b.id)",
    "target_symbols": f"WITH {_SYM}, t AS (SELECT n_nationkey AS target_id, CASE WHEN n_nationkey % 2 = 0 THEN 'src/brand_' || n_nationkey || '.rs' WHEN n_nationkey % 3 = 0 THEN 'cold_widget' ELSE 'nothing_of_that_name' END AS target FROM nation) SELECT target_id, symbol_id, row_number() OVER (PARTITION BY target_id ORDER BY path, line_start, name) AS rank FROM t JOIN sym ON path = target OR name = target QUALIFY rank <= 5",
    "impact_report": f"WITH {_SYM}, {_LINK}, {_PP}, {_T}, i AS (SELECT * FROM lk WHERE {_IN}), o AS (SELECT * FROM lk WHERE {_OUT}), f AS (SELECT path FROM t UNION SELECT path FROM i UNION SELECT target_path FROM i UNION SELECT path FROM o UNION SELECT target_path FROM o), "
    f"a AS (SELECT {_STEM.format('path')} AS stem FROM f WHERE NOT {_ISTEST.format('path')}), tp AS (SELECT path, lower(path) AS low, {_STEM.format('path')} AS ts FROM pp WHERE {_ISTEST.format('path')}), tm AS (SELECT DISTINCT tp.path FROM tp JOIN a ON strlen(stem) >= 3 AND (contains(low, stem) OR contains(ts, stem))) SELECT (SELECT count(*) FROM t) AS symbols, (SELECT count(*) FROM i) AS inbound, (SELECT count(*) FROM o) AS outbound, (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM tm) AS tests, (SELECT min(path) FROM f) AS first_file, (SELECT max(path) FROM f) AS last_file",
    "path_references": f"WITH {_SYM}, {_LINK} SELECT line_start, target_path, target_name, kind FROM lk WHERE path = 'src/brand_13.rs' ORDER BY line_start, target_path, target_name, kind LIMIT 40",
    "known_paths": f"WITH {_SYM}, {_LINK} SELECT DISTINCT target_path AS value FROM lk",
    "first_best_tests": "WITH r AS (SELECT (l_suppkey % 40)::VARCHAR AS test_path, floor(l_quantity)::BIGINT AS score, l_returnflag AS reason, l_orderkey * 10 + l_linenumber AS place FROM lineitem) SELECT test_path, score, reason FROM r QUALIFY row_number() OVER (PARTITION BY test_path ORDER BY score DESC, place) = 1",
    "padded_vectors": "SELECT vec_id, 1536 AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, 7 AS cut, round(embedding[7]::DOUBLE, 4) AS last FROM embeddings",
    "index_full": f"WITH {_FN} SELECT path, count(*) AS symbols, count(nxt) AS \"references\" FROM fn GROUP BY path",
    "index_incremental": f"WITH {_FN}, n AS (SELECT *, CASE WHEN k // {M.PER_FILE} % 3 = 1 THEN 'new_' ELSE '' END || name AS now FROM fn WHERE k // {M.PER_FILE} % 5 <> 4), x AS (SELECT path, now AS name, 'symbol' AS what FROM n UNION ALL SELECT a.path, a.nxt, 'reference' FROM n a JOIN n b ON b.path = a.npath AND b.now = a.nxt) SELECT path, what, count(*) AS n, min(name) AS first, max(name) AS last FROM x GROUP BY ALL",
    "file_upsert": f"WITH {_PP}, p AS (SELECT path, length(path) AS n FROM pp) SELECT path, CASE WHEN n % 2 = 0 THEN 'new' ELSE 'old' END AS language, CASE WHEN n % 2 = 0 THEN n + 1 ELSE n END AS size_bytes, CASE WHEN n % 3 <> 0 THEN 10 ELSE 77 END AS discovered_at_ms, CASE WHEN n % 2 = 0 THEN 77 ELSE 11 END AS updated_at_ms FROM p WHERE n % 2 = 0 OR n % 3 <> 0",
    "test_refresh": f"WITH {_PP}, m AS ({_TM}) SELECT path, 'tests/old.rs' AS test_path, 1::BIGINT AS score FROM pp WHERE path LIKE 'src/brand%' UNION ALL SELECT path, test_path, score FROM m WHERE path LIKE 'src/Brand%Order.java'",
    "due_embeddings": "WITH k AS (" + RECALL["content_keys"] + ") SELECT query_id::VARCHAR AS path, content_key FROM k WHERE query_id % 6 <> 1",
    "deleted_paths": f"WITH {_PP} SELECT path FROM pp WHERE regexp_replace(replace(trim(path), chr(92), '/'), '^(\\./)+', '') <> path OR path NOT LIKE '%supplier%7%'",
    "sync_plan": f"WITH {_SES} SELECT 'memories' AS \"table\", (SELECT count(*) FROM documents) AS \"rows\" UNION ALL SELECT 'sessions', (SELECT count(*) FROM se WHERE final_summary IS NOT NULL) UNION ALL SELECT 'entities', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) UNION ALL SELECT 'edges', (SELECT count(*) FROM nation) UNION ALL SELECT 'code_symbols', (SELECT count(*) FROM part)",
    "sync_run": f"WITH {_SRC}, c AS (SELECT (SELECT count(*) FROM l) AS l, (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM l JOIN r USING (id)) AS b, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS g) "
    "SELECT 'push' AS operation, 'sources' AS \"table\", r AS before, l + r - b AS after, l - b AS inserted, b AS updated, 0::BIGINT AS skipped FROM c UNION ALL SELECT 'pull', 'sources', l, l + r - b, r - b, 0, b FROM c UNION ALL SELECT 'push', 'entities', n, n + g, g, 0, n FROM c UNION ALL SELECT 'pull', 'entities', n + g, n + g, 0, 0, n FROM c",
    "sync_payload": f"WITH {_SRC} SELECT * FROM l UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM l)",
    "sync_events": "SELECT CASE WHEN conv_id % 4 <> 0 THEN 'accepted' ELSE 'missing_session' END AS reason, count(*) AS n FROM conversations GROUP BY 1",
    "sync_history": "WITH n AS (SELECT n_nationkey AS k, (n_regionkey * 1000)::BIGINT AS started_at_ms, n_nationkey::VARCHAR AS id FROM nation ORDER BY n_regionkey DESC, n_nationkey::VARCHAR LIMIT 10) SELECT id, started_at_ms, 'edges:' || k || CASE WHEN k % 2 = 0 THEN ':' || k ELSE '' END || ',sources:' || k AS tables FROM n",
    "sync_pull_summary": f"WITH {_ORD}, m AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN l.o_orderkey IS NULL OR r.updated_at > l.updated_at THEN r.o_custkey ELSE l.o_custkey END AS o_custkey, CASE WHEN l.o_orderkey IS NULL OR r.updated_at > l.updated_at THEN r.updated_at ELSE l.updated_at END AS updated_at FROM l FULL JOIN r USING (o_orderkey)) {_SUM}",
    "eval_skips": f"WITH {_CASES} SELECT reason, count(*) AS n FROM rs WHERE reason IS NOT NULL AND ((SELECT count(*) FROM ok) < {WANTED} OR k > (SELECT min(k) FROM ok)) GROUP BY reason",
    "eval_replay": f"WITH {_REPLAY} SELECT hash, recall, first_hit_rank, symbol_hit, candidate_hit, retrievable FROM sc",
    "eval_means": f"WITH {_REPLAY} SELECT count(*) AS cases, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(CASE WHEN first_hit_rank IS NULL THEN 0.0 ELSE 1.0 END), 0), 6) AS hit_rate, round(coalesce(avg(coalesce(1.0 / first_hit_rank, 0)), 0), 6) AS mrr, round(coalesce(avg(symbol_hit::INT), 0), 6) AS symbol_hit_rate, round(coalesce(avg(candidate_hit::INT), 0), 6) AS candidate_hit_rate, round(coalesce(avg(retrievable::INT), 0), 6) AS retrievable_rate FROM sc",
}
ORACLES = {name: once(sql) for name, sql in ORACLES.items()}
