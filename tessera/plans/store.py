"""Registered queries of sessions, diagnostics, freshness, replication, packs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import files as FI
from tessera.operators import memory, pack, sessions, sync
from tessera.plans.recall import _values
from tessera.sources import model as M
from tessera.streaming import events as S



def _orders(spark, d):
    o = M.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    local = o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 1000).alias("updated_at"))
    remote = o.where("o_orderkey % 4 <> 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), (F.col("o_orderkey") % 1000 + F.col("o_orderkey") % 5 - 2).alias("updated_at"))
    return local, remote


def _summary(df):
    return df.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"), F.sum("updated_at").alias("updated"), F.sum(F.col("o_orderkey") * F.col("updated_at")).alias("mixed"))


def sync_push(spark, d):
    return _summary(sync.push(*_orders(spark, d), "o_orderkey"))


def sync_pull_newer(spark, d):
    return _summary(sync.pull_newer(*_orders(spark, d), "o_orderkey", "updated_at"))


def sync_pull_missing(spark, d):
    return _summary(sync.pull_missing(*_orders(spark, d), "o_orderkey"))


def sync_conflicts(spark, d):
    return sync.conflicts(*_orders(spark, d), "o_orderkey", "updated_at")


def sync_orphans(spark, d):
    o = M.read(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return sync.orphans(M.read(spark, d, "lineitem").select("l_orderkey"), o, "l_orderkey", "missing_order")


def sync_pull_retirement(spark, d):
    m = M.memories(spark, d).select("id", "kind", "valid_to", "superseded_by")
    remote = m.where("id % 3 <> 1").withColumn("valid_to", F.when(F.col("id") % 4 == 0, "5")).withColumn("kind", F.lit("remote"))
    return sync.pull_retirement(m.where("id % 7 <> 0"), remote, "id").select("id", "kind", "valid_to")


def sync_pull_sessions(spark, d):
    s = M.sessions(spark, d).select("session_id", "started_at_ms", "ended_at_ms", "final_summary")
    later = s.withColumn("ended_at_ms", F.col("ended_at_ms") + F.col("session_id") % 3 - 1).withColumn("started_at_ms", F.col("started_at_ms") + 7)
    return sync.pull_sessions(s.where("session_id % 4 <> 0"), later).select("session_id", "started_at_ms", "ended_at_ms")


def session_facts(spark, d):
    f = sessions.facts(M.sessions(spark, d), M.session_events(spark, d))
    return sessions.fact_rank(f, "the assistant reading with summary", 100, 20).select("session_id", "kind", F.md5(F.col("detail").cast("binary")).alias("detail"), "at", F.col("score").cast("long").alias("score"))


def unpromoted_sessions(spark, d):
    return sessions.to_promote(M.sessions(spark, d), M.session_events(spark, d))


def session_digest(spark, d):
    return sessions.digest(M.sessions(spark, d), M.session_events(spark, d), 3).select("session_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def session_latest(spark, d):
    return sessions.latest(M.sessions(spark, d))


def diagnostic_rank(spark, d):
    g = M.diagnostics(spark, d)
    some = g.select("path").where("path like '%7.rs'").distinct()
    return sessions.diagnostic_rank(g, "purchase error user", some, 1000, 25).select("id", "path", "severity", F.col("score").cast("long").alias("score"))


def freshness(spark, d):
    f = M.files(spark, d).select("path", (F.col("size_bytes") * 10).alias("modified_at_ms"))
    indexed = M.files(spark, d).where("size_bytes % 4 <> 0").select("path", (F.col("size_bytes") * 10 - F.when(F.col("size_bytes") % 3 == 0, 1500).otherwise(0)).alias("indexed_at_ms"))
    return sessions.freshness(f, indexed, 40)


def edits_after_pack(spark, d):
    e = M.read(spark, d, "events").select(F.concat(F.lit("edited src/user_"), F.col("user_id").cast("string"), F.lit(".rs twice")).alias("detail"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    paths = M.diagnostics(spark, d).select("path").distinct()
    return sessions.edits_after(paths, e, 1704153600000)


def list_summaries(spark, d):
    g = M.read(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return g.select("n_regionkey", X.list_summary(F.col("names"), 3).alias("summary"))


def _pack_items(spark, d):
    o = M.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("pack_id", "section").orderBy(F.desc("score"), "o_orderkey")
    rows = o.select((F.col("o_custkey") % 50).alias("pack_id"), (F.col("o_orderkey") % 9).cast("int").alias("section"), F.floor("o_totalprice").alias("score"), "o_orderkey", (F.col("o_orderkey") % 70 + 20).alias("tokens"))
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 12").drop("o_orderkey")


def pack_budget(spark, d):
    return pack.evict(_pack_items(spark, d), 1500, 66).groupBy("pack_id", "section").agg(F.count_if("evicted").alias("evicted"), F.count_if(~F.col("evicted")).alias("kept"), F.sum(F.when(~F.col("evicted"), F.col("tokens")).otherwise(0)).alias("tokens"))


def best_tests(spark, d):
    rows = M.read(spark, d, "lineitem").select((F.col("l_suppkey") % 40).cast("string").alias("test_path"), F.floor("l_quantity").cast("long").alias("score"), F.col("l_returnflag").alias("reason"))
    return FI.best_per_path(rows).select("test_path", "score", "reason")


def event_sessions(spark, d):
    return S.batch_sessions(M.read(spark, d, "events"), 30 * 60)


QUERIES = {
    f.__name__: f
    for f in (sync_push, sync_pull_newer, sync_pull_missing, sync_conflicts, sync_orphans, sync_pull_retirement, sync_pull_sessions, session_facts, unpromoted_sessions, session_digest, session_latest, diagnostic_rank, freshness, edits_after_pack, list_summaries, pack_budget, best_tests, event_sessions)
}

_ORD = "l AS (SELECT o_orderkey, o_custkey, o_orderkey % 1000 AS updated_at FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_orderkey % 1000 + o_orderkey % 5 - 2 AS updated_at FROM orders WHERE o_orderkey % 4 <> 0)"
_SUM = "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS customers, sum(updated_at)::BIGINT AS updated, sum(o_orderkey * updated_at)::BIGINT AS mixed FROM m"
_SES = "ev AS (SELECT conv_id AS session_id, turn AS seq, role AS kind, text AS detail FROM conversations), se AS (SELECT session_id, min_by(detail, seq) FILTER (kind = 'user') AS task, session_id * 60000 AS started_at_ms, CASE WHEN session_id % 7 <> 0 THEN session_id * 60000 + count(*) * 1000 END AS ended_at_ms, CASE WHEN session_id % 7 <> 0 THEN max_by(detail, seq) FILTER (kind = 'assistant') END AS final_summary, session_id % 5 = 0 AS promoted FROM ev GROUP BY session_id)"
_TOLD = "CASE WHEN starts_with(detail, kind || ':') THEN detail ELSE kind || ': ' || detail END"
_DIAG = "g AS (SELECT event_id AS id, 'src/user_' || user_id || '.rs' AS path, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'note' END AS severity, event_type || ' while handling user ' || user_id AS message, (epoch_us(ts) // 1000) AS created_at_ms FROM events)"
_FL = "fl AS (SELECT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || CASE page_id % 3 WHEN 0 THEN '_test.py' WHEN 1 THEN '.rs' ELSE '.md' END AS path, length(html) AS size_bytes FROM pages)"
_MEM = "m AS (SELECT doc_id AS id, source AS kind, CASE WHEN doc_id % 10 = 0 THEN (doc_id * 1000 + 500)::VARCHAR END AS valid_to FROM documents)"
ORACLES = {
    "sync_push": f"WITH {_ORD}, m AS (SELECT * FROM l UNION ALL SELECT * FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)) {_SUM}",
    "sync_pull_newer": f"WITH {_ORD}, m AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN l.o_orderkey IS NULL OR r.updated_at > l.updated_at THEN r.o_custkey ELSE l.o_custkey END AS o_custkey, CASE WHEN l.o_orderkey IS NULL OR r.updated_at > l.updated_at THEN r.updated_at ELSE l.updated_at END AS updated_at FROM l FULL JOIN r USING (o_orderkey)) {_SUM}",
    "sync_pull_missing": f"WITH {_ORD}, m AS (SELECT * FROM l UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.o_orderkey = r.o_orderkey)) {_SUM}",
    "sync_conflicts": f"WITH {_ORD} SELECT CASE WHEN l.o_orderkey IS NULL THEN 'inserted' WHEN r.updated_at > l.updated_at THEN 'updated' ELSE 'local_row_newer_or_equal' END AS reason, count(*) AS n FROM r LEFT JOIN l USING (o_orderkey) GROUP BY 1",
    "sync_orphans": "SELECT 'missing_order' AS reason, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)",
    "sync_pull_retirement": f"WITH {_MEM}, l AS (SELECT * FROM m WHERE id % 7 <> 0), r AS (SELECT id, 'remote' AS kind, CASE WHEN id % 4 = 0 THEN '5' END AS valid_to FROM m WHERE id % 3 <> 1) SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN r.kind ELSE l.kind END AS kind, coalesce(l.valid_to, r.valid_to) AS valid_to FROM l FULL JOIN r ON l.id = r.id",
    "sync_pull_sessions": f"WITH {_SES}, l AS (SELECT session_id, started_at_ms, ended_at_ms FROM se WHERE session_id % 4 <> 0), r AS (SELECT session_id, started_at_ms + 7 AS started_at_ms, ended_at_ms + session_id % 3 - 1 AS ended_at_ms FROM se WHERE final_summary IS NOT NULL) "
    "SELECT coalesce(l.session_id, r.session_id) AS session_id, CASE WHEN r.session_id IS NOT NULL AND (l.session_id IS NULL OR l.ended_at_ms IS NULL OR r.ended_at_ms > l.ended_at_ms) THEN r.started_at_ms ELSE l.started_at_ms END AS started_at_ms, CASE WHEN r.session_id IS NOT NULL AND (l.session_id IS NULL OR l.ended_at_ms IS NULL OR r.ended_at_ms > l.ended_at_ms) THEN r.ended_at_ms ELSE l.ended_at_ms END AS ended_at_ms FROM l FULL JOIN r ON l.session_id = r.session_id",
    "session_facts": f"""WITH {_SES}, f AS (SELECT session_id, 'task' AS kind, task AS detail, started_at_ms AS "at" FROM se WHERE task IS NOT NULL UNION ALL SELECT ev.session_id, kind, detail, started_at_ms + seq * 1000 FROM ev JOIN se USING (session_id) UNION ALL SELECT session_id, 'summary', final_summary, ended_at_ms FROM se WHERE final_summary IS NOT NULL), n AS (SELECT * FROM f ORDER BY "at" DESC, session_id, kind, detail LIMIT 100), s AS (SELECT *, len(list_filter(['the', 'assistant', 'reading', 'with', 'summary'], lambda t: contains(lower(kind || ' ' || detail), t))) AS score FROM n) SELECT session_id, kind, md5(detail) AS detail, "at", score FROM s WHERE score > 0 ORDER BY score DESC, s."at" DESC, session_id, kind, s.detail LIMIT 20""",
    "unpromoted_sessions": f"WITH {_SES} SELECT session_id, ended_at_ms FROM se WHERE ended_at_ms IS NOT NULL AND NOT promoted AND (final_summary IS NOT NULL OR EXISTS (SELECT 1 FROM ev WHERE ev.session_id = se.session_id))",
    "session_digest": f"WITH {_SES}, e AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, kind, detail) AS n, {_TOLD} AS t FROM ev), u AS (SELECT * FROM e WHERE n <= 3 UNION ALL SELECT session_id, 4, CASE WHEN starts_with(final_summary, 'summary:') THEN final_summary ELSE 'summary: ' || final_summary END FROM se WHERE final_summary IS NOT NULL), g AS (SELECT session_id, string_agg(t, '; ' ORDER BY n) AS text FROM u GROUP BY 1) SELECT session_id, length(text) AS n_chars, md5(text) AS digest FROM g",
    "session_latest": f"WITH {_SES} SELECT (SELECT session_id FROM se WHERE ended_at_ms IS NULL ORDER BY started_at_ms DESC, session_id DESC LIMIT 1) AS open_session, (SELECT session_id FROM se ORDER BY coalesce(ended_at_ms, started_at_ms) DESC, session_id DESC LIMIT 1) AS latest_session",
    "diagnostic_rank": f"WITH {_DIAG}, n AS (SELECT * FROM g ORDER BY created_at_ms DESC, id LIMIT 1000), b AS (SELECT *, CASE WHEN path LIKE '%7.rs' THEN 120 ELSE 0 END + 20 * len(list_filter(['purchase', 'error', 'user'], lambda t: contains(lower(severity || ' ' || path || ' ' || message), t))) AS base FROM n), s AS (SELECT *, CASE WHEN base > 0 AND severity = 'error' THEN base + 10 ELSE base END AS score FROM b) SELECT id, path, severity, score FROM s WHERE score > 0 ORDER BY score DESC, created_at_ms DESC, id LIMIT 25",
    "freshness": f"WITH {_FL}, i AS (SELECT path, max(size_bytes * 10 - CASE WHEN size_bytes % 3 = 0 THEN 1500 ELSE 0 END) AS indexed FROM fl WHERE size_bytes % 4 <> 0 GROUP BY path), j AS (SELECT fl.path, size_bytes * 10 AS modified_at_ms, CASE WHEN indexed IS NULL THEN 'missing_index' WHEN size_bytes * 10 > indexed + 1000 THEN 'stale_index' END AS kind FROM fl LEFT JOIN i USING (path)) SELECT path, kind, modified_at_ms FROM j WHERE kind IS NOT NULL ORDER BY kind = 'stale_index' DESC, modified_at_ms DESC, path LIMIT 40",
    "edits_after_pack": "SELECT 'src/user_' || user_id || '.rs' AS path, max((epoch_us(ts) // 1000)) AS edited_at_ms FROM events WHERE (epoch_us(ts) // 1000) > 1704153600000 GROUP BY 1",
    "list_summaries": "WITH g AS (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY 1) SELECT n_regionkey, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' (+' || (len(l) - 3) || ' more)' ELSE '' END AS summary FROM g",
    "best_tests": "WITH r AS (SELECT (l_suppkey % 40)::VARCHAR AS test_path, floor(l_quantity)::BIGINT AS score, l_returnflag AS reason FROM lineitem) SELECT test_path, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY test_path ORDER BY score DESC, reason) AS k FROM r) WHERE k = 1",
    "event_sessions": "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS events, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms FROM s GROUP BY user_id, k",
    # the greedy rule, unrolled: an item's turn is the largest value behind it, and items go while what is left does not fit
    "pack_budget": "WITH o AS (SELECT o_custkey % 50 AS pack_id, (o_orderkey % 9)::INT AS section, floor(o_totalprice)::BIGINT AS score, o_orderkey, o_orderkey % 70 + 20 AS tokens FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY pack_id, section ORDER BY score DESC, o_orderkey) AS rank FROM o), i AS (SELECT *, (score * 64) // tokens AS v, CASE WHEN rank > 3 THEN 1 ELSE 2 END AS phase FROM r WHERE rank <= 12), "
    "t AS (SELECT a.pack_id, a.section, a.rank, a.tokens, a.phase, max(b.v) AS turn FROM i a JOIN i b ON a.pack_id = b.pack_id AND a.section = b.section AND a.phase = b.phase AND b.rank >= a.rank GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY phase, turn, section, rank DESC) AS place, rank = max(rank) OVER (PARTITION BY pack_id, section) AS firsts FROM t), "
    "e AS (SELECT x.pack_id, x.section, x.rank, x.tokens, 66 + (SELECT sum(tokens) FROM q y WHERE y.pack_id = x.pack_id) - coalesce((SELECT sum(tokens - CASE WHEN firsts THEN 8 ELSE 0 END) FROM q y WHERE y.pack_id = x.pack_id AND y.place < x.place), 0) > 1500 AS gone FROM q x) SELECT pack_id, section, count(*) FILTER (gone) AS evicted, count(*) FILTER (NOT gone) AS kept, coalesce(sum(tokens) FILTER (NOT gone), 0)::BIGINT AS tokens FROM e GROUP BY ALL",
}
