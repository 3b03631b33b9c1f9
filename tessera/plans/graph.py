"""Registered queries over the code graph, code text and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.operators import code, files, graph, pack
from tessera.plans.recall import _values
from tessera.sources import model as M

TASK = "green almond handler test for pages"
SYMBOL_QUERIES = [(1, "goldenrod lavender"), (2, "promo burnished"), (3, "standard"), (4, "blue")]


def _symbols(spark, d):
    return M.symbols(spark, d)


def symbol_rank(spark, d):
    q = spark.createDataFrame(SYMBOL_QUERIES, "query_id long, query string")
    q = q.withColumn("terms", X.query_terms("query"))  # split once, not for every symbol
    s = _symbols(spark, d).crossJoin(F.broadcast(q))  # a stated set of four queries
    s = s.where(X.symbol_prefilter(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), F.col("terms")))
    score = X.symbol_score(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), F.col("terms"), F.col("query"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "line_start")
    r = s.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w))
    return r.where("rank <= 20").select("query_id", "symbol_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def refs_to_symbols(spark, d):
    some = _symbols(spark, d).where("kind = 'promo'")
    return graph.incoming(M.references(spark, d), some).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def refs_in_symbol_range(spark, d):
    return graph.inside(M.code_links(spark, d), _symbols(spark, d)).groupBy("path").agg(F.count("*").alias("n"), F.min("line_start").alias("first_line"))


def graph_collapse(spark, d):
    return graph.collapse(M.references(spark, d))


def most_connected(spark, d):
    c = graph.collapse(M.references(spark, d)).join(_symbols(spark, d).select(F.col("symbol_id").alias("target_id"), F.col("path").alias("target_path")), "target_id")
    return graph.most_connected(c, "path", "target_path")


def fan_in(spark, d):
    return graph.fan_in(M.references(spark, d))


def neighbour_rank(spark, d):
    s = _symbols(spark, d).select(F.col("symbol_id").alias("target_id"), F.col("path").alias("target_path"), F.col("name").alias("label"))
    n = graph.collapse(M.references(spark, d).where("kind <> 'reference'")).join(s, "target_id").withColumn("kind", F.when(F.col("kind") == "call", "incoming_reference").otherwise("path_reference"))
    return graph.neighbour_rank(n.groupBy("kind", "label", "path", "target_path").agg(F.sum("site_count").alias("site_count")), "goldenrod supplier_1", 12).select("kind", "label", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def impact_files(spark, d):
    t = _symbols(spark, d).where("kind = 'promo'").select("symbol_id")
    return graph.impact(_symbols(spark, d), M.references(spark, d), t).groupBy("role").agg(F.count("*").alias("files"))


def inbound_sources(spark, d):
    changed = _symbols(spark, d).where("path = 'src/brand_11.rs'").select(F.col("symbol_id").alias("target_id"))
    return M.references(spark, d).join(changed, "target_id", "left_semi").select("path").distinct()


def prune_missing(spark, d):
    refs = M.references(spark, d).select("path", "target_id", "line_start")
    live = M.read(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("src/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".rs")).alias("path"))
    return graph.prune(refs, live, "path").agg(F.count("*").alias("kept"), F.countDistinct("path").alias("files"))


def replace_index(spark, d):
    refs = M.references(spark, d).select("path", "line_start")
    fresh = refs.where("line_start % 2 = 0")
    out = graph.replace_paths(refs, fresh, refs.where("path like '%1.rs'").select("path").distinct())
    return out.groupBy("path").agg(F.count("*").alias("n"))


def edge_labels(spark, d):
    edges = M.read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to_id"), F.lit("in").alias("kind"))
    entities = M.read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"))
    return graph.label_edges(edges, entities)


def file_candidates(spark, d):
    return files.candidates(M.files(spark, d), TASK, 25).select("path", F.col("lexical_score").cast("long").alias("lexical_score"), F.col("relevance").cast("long").alias("relevance"))


def file_promotion(spark, d):
    f = M.files(spark, d)
    s = f.where(F.pmod(F.length("path"), F.lit(7)) == 0).select("path")
    return files.promote(files.candidates(f, TASK, None), s).groupBy("lexical_score").agg(F.count("*").alias("n"), F.sum("relevance").alias("relevance")).select(F.col("lexical_score").cast("long").alias("lexical_score"), "n", "relevance")


def file_merge(spark, d):
    f = M.files(spark, d)
    v = f.withColumn("embedding_rank", (F.col("size_bytes") % 60 + 1).cast("int"))
    m = files.merge(files.candidates(f, TASK, None), v)
    return m.select("path", F.col("lexical_score").cast("long").alias("lexical_score"), F.col("embedding_rank").cast("long").alias("embedding_rank"), F.col("relevance").cast("long").alias("relevance"))


def file_languages(spark, d):
    f = M.files(spark, d)
    return f.groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"), F.count_if(P.is_test("path")).alias("tests"))


def risk_signals(spark, d):
    s = _symbols(spark, d).withColumn("parameters", F.when(F.col("symbol_id") % 50 == 0, 9).otherwise(F.col("symbol_id") % 5))
    s = s.withColumn("line_end", F.when(F.col("symbol_id") % 40 == 0, F.col("line_end") + 120).otherwise(F.col("line_end")))
    refs = M.references(spark, d)
    n = graph.collapse(refs).select("path", F.concat(F.lit("src/"), F.col("target_id").cast("string")).alias("target_path"), "site_count")
    return pack.risk_signals(s, graph.fan_in(refs), n)


QUERIES = {
    f.__name__: f
    for f in (symbol_rank, refs_to_symbols, refs_in_symbol_range, graph_collapse, most_connected, fan_in, neighbour_rank, impact_files, inbound_sources, prune_missing, replace_index, edge_labels, file_candidates, file_promotion, file_merge, file_languages, risk_signals)
}

_SYM = "sym AS (SELECT 'src/' || lower(replace(p_brand, '#', '_')) || '.rs' AS path, replace(p_name, ' ', '_') AS name, lower(split_part(p_type, ' ', 1)) AS kind, p_partkey AS line_start, p_partkey + p_size AS line_end, 'fn ' || replace(p_name, ' ', '_') || '(' || lower(p_type) || ')' AS signature, p_partkey AS symbol_id FROM part)"
_REF = "ref AS (SELECT 'src/supplier_' || l_suppkey || '.rs' AS path, l_orderkey * 10 + l_linenumber AS line_start, l_partkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'import' ELSE 'reference' END AS kind FROM lineitem)"
_LINK = "lk AS (SELECT CASE WHEN l_linenumber = 1 THEN o.path ELSE 'src/supplier_' || l_suppkey || '.rs' END AS path, CASE WHEN l_linenumber = 1 THEN l_partkey + l_orderkey % 5 ELSE l_orderkey * 10 + l_linenumber END AS line_start, t.path AS target_path, t.name AS target_name, t.kind AS target_kind, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'import' ELSE 'reference' END AS kind, CASE l_returnflag WHEN 'A' THEN t.name || '();' ELSE '' END AS excerpt FROM lineitem JOIN sym o ON o.symbol_id = l_partkey JOIN sym t ON t.symbol_id = CASE WHEN l_linenumber = 1 THEN l_orderkey % 100 ELSE l_partkey END)"
_COL = "col AS (SELECT kind, path, target_id, count(*) AS site_count, min(line_start) AS line_start FROM ref GROUP BY ALL)"
_NAME = "regexp_extract({0}, '[^/]*$')"
_LANG = "CASE regexp_extract({0}, '\\.([^./]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in P.LANGUAGES.items()) + " END"
_ISTEST = "(regexp_matches(lower({0}), '(^|/)(tests|test|__tests__|spec|specs)(/|$)') OR regexp_matches(lower(regexp_extract({0}, '[^/]*$')), '^test_|_test\\.go$|_test\\.rs$|_tests\\.rs$|\\.test\\.|\\.spec\\.|_spec\\.rb$|_test\\.py$') OR regexp_matches(regexp_extract({0}, '[^/]*$'), '\\p{{Ll}}(Test|Tests|Spec|IT)\\.(java|kt|kts|swift)$'))"
_STEM = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(regexp_extract({0}, '[^/]*$'), '.', 1), '(\\p{{Ll}})(Tests|Test|Spec|IT)$', '\\1'), '^(test_)+', ''), '(_test)+$', ''), '(_tests)+$', ''), '(_spec)+$', ''))"
_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
_FILE = f"fl AS (SELECT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || CASE page_id % 3 WHEN 0 THEN '_test.py' WHEN 1 THEN '.rs' ELSE '.md' END AS path, length(html) AS size_bytes FROM pages), fi AS (SELECT path, size_bytes, {_LANG.format('path')} AS language FROM fl)"
_TASKTERMS = "[" + ", ".join(f"'{w}'" for w in TASK.split() if len(w) > 2) + "]"
_CAND = (
    f"cd AS (SELECT path, size_bytes, list_sum(list_transform({_TASKTERMS}, lambda t: CASE WHEN split_part(lower({_NAME.format('path')}), '.', 1) = t THEN 8 WHEN contains(lower({_NAME.format('path')}), t) THEN 4 WHEN contains(lower(path), t) THEN 2 ELSE 0 END + CASE WHEN language = t THEN 3 ELSE 0 END)) AS raw, {_ISTEST.format('path')} AS test FROM fi), "
    "ca AS (SELECT path, size_bytes, CASE WHEN test THEN raw // 2 ELSE raw END::BIGINT AS lexical_score FROM cd WHERE CASE WHEN test THEN raw // 2 ELSE raw END > 0)"
)
_SMALL = "CASE WHEN size_bytes <= 128000 THEN 10 ELSE 0 END"
_WORDS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '[^\p{L}\p{N}]+'), lambda w: lower(w)), lambda w: strlen(w) >= 2)"
ORACLES = {
    "symbol_rank": f"WITH {_SYM}, q(query_id, query) AS (VALUES {_values(SYMBOL_QUERIES)}), s AS (SELECT query_id, query, sym.*, string_split(query, ' ') AS ts, {_WORDS} AS ws FROM sym, q), "
    "t AS (SELECT *, list_sum(list_transform(ts, lambda t: CASE WHEN lower(name) = t THEN 10 WHEN list_contains(ws, t) THEN 7 WHEN len(list_filter(ws, lambda w: (starts_with(w, t) OR starts_with(t, w)) AND least(strlen(w), strlen(t)) >= 4 AND abs(strlen(w) - strlen(t)) <= 3)) > 0 THEN 6 WHEN contains(lower(name), t) THEN 5 ELSE 0 END + CASE WHEN kind = t THEN 3 ELSE 0 END + CASE WHEN contains(lower(path), t) THEN 2 ELSE 0 END + CASE WHEN contains(lower(signature), t) THEN 1 ELSE 0 END)) AS ts_score FROM s), "
    "r AS (SELECT query_id, symbol_id, (ts_score + CASE WHEN lower(name) = query OR contains(lower(signature), query) THEN 12 ELSE 0 END)::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY ts_score + CASE WHEN lower(name) = query OR contains(lower(signature), query) THEN 12 ELSE 0 END DESC, path, line_start) AS rank FROM t) SELECT * FROM r WHERE score > 0 AND rank <= 20",
    "refs_to_symbols": f"WITH {_SYM}, {_REF} SELECT kind, count(*) AS n, count(DISTINCT path) AS files FROM ref WHERE target_id IN (SELECT symbol_id FROM sym WHERE kind = 'promo') GROUP BY kind",
    "refs_in_symbol_range": f"WITH {_SYM}, {_LINK} SELECT path, count(*) AS n, min(line_start) AS first_line FROM lk WHERE EXISTS (SELECT 1 FROM sym WHERE sym.path = lk.path AND lk.line_start BETWEEN sym.line_start AND sym.line_end) GROUP BY path",
    "graph_collapse": f"WITH {_REF}, {_COL} SELECT * FROM col",
    "most_connected": f"WITH {_SYM}, {_REF}, {_COL}, e AS (SELECT unnest([col.path, sym.path]) AS node, site_count FROM col JOIN sym ON sym.symbol_id = target_id) SELECT node, sum(site_count)::BIGINT AS sites FROM e GROUP BY node ORDER BY sites DESC, node LIMIT 1",
    "fan_in": f'WITH {_REF} SELECT target_id, count(*) AS "references", count(DISTINCT path) AS files FROM ref GROUP BY target_id',
    "neighbour_rank": f"WITH {_SYM}, {_REF}, n AS (SELECT CASE ref.kind WHEN 'call' THEN 'incoming_reference' ELSE 'path_reference' END AS kind, name AS label, ref.path, sym.path AS target_path, count(*) AS sites FROM ref JOIN sym ON symbol_id = target_id WHERE ref.kind <> 'reference' GROUP BY ALL), "
    "s AS (SELECT *, (CASE kind WHEN 'incoming_reference' THEN 700 ELSE 640 END + 40 * (contains(lower(kind || ' ' || label || ' ' || path), 'goldenrod')::INT + contains(lower(kind || ' ' || label || ' ' || path), 'supplier_1')::INT) + least(sites, 6) * 10 - CASE WHEN path = target_path THEN 120 ELSE 0 END)::BIGINT AS score FROM n), r AS (SELECT kind, label, path, score, row_number() OVER (ORDER BY score DESC, kind, label, path) AS rank FROM s) SELECT * FROM r WHERE rank <= 12",
    "impact_files": f"WITH {_SYM}, {_REF}, t AS (SELECT * FROM sym WHERE kind = 'promo'), u AS (SELECT path AS file, 'defines' AS role FROM t UNION SELECT path, 'incoming' FROM ref WHERE target_id IN (SELECT symbol_id FROM t) UNION SELECT sym.path, 'outgoing' FROM ref JOIN sym ON symbol_id = target_id WHERE EXISTS (SELECT 1 FROM t WHERE t.path = ref.path AND ref.line_start BETWEEN t.line_start AND t.line_end)) SELECT role, count(*) AS files FROM u GROUP BY role",
    "inbound_sources": f"WITH {_SYM}, {_REF} SELECT DISTINCT path FROM ref WHERE target_id IN (SELECT symbol_id FROM sym WHERE path = 'src/brand_11.rs')",
    "prune_missing": f"WITH {_REF} SELECT count(*) AS kept, count(DISTINCT path) AS files FROM ref WHERE path IN (SELECT 'src/supplier_' || s_suppkey || '.rs' FROM supplier WHERE s_suppkey % 3 <> 0)",
    "replace_index": f"WITH {_REF} SELECT path, count(*) AS n FROM ref WHERE path NOT LIKE '%1.rs' OR line_start % 2 = 0 GROUP BY path",
    "edge_labels": "SELECT n_nationkey::VARCHAR AS id, 'in' AS kind, 'n' || n_nationkey AS from_label, r_name AS to_label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "file_candidates": f"WITH {_FILE}, {_CAND} SELECT path, lexical_score, lexical_score * 20 + {_SMALL} AS relevance FROM ca ORDER BY relevance DESC, path LIMIT 25",
    "file_promotion": f"WITH {_FILE}, {_CAND}, s AS (SELECT DISTINCT path FROM fi WHERE length(path) % 7 = 0), u AS (SELECT ca.path, size_bytes, lexical_score + CASE WHEN s.path IS NULL THEN 0 ELSE 6 END AS lexical_score FROM ca LEFT JOIN s USING (path) UNION ALL SELECT path, NULL, 6 FROM s WHERE path NOT IN (SELECT path FROM ca)) SELECT lexical_score::BIGINT AS lexical_score, count(*) AS n, sum(lexical_score * 20 + {_SMALL})::BIGINT AS relevance FROM u GROUP BY lexical_score",
    "file_merge": f"WITH {_FILE}, {_CAND}, v AS (SELECT path, size_bytes, (size_bytes % 60 + 1)::BIGINT AS rk FROM fi), m AS (SELECT path, max(ls) AS lexical_score, min(rk) AS embedding_rank, max(size_bytes) AS size_bytes FROM (SELECT path, lexical_score AS ls, NULL::BIGINT AS rk, size_bytes FROM ca UNION ALL SELECT path, 0, rk, size_bytes FROM v) GROUP BY path) SELECT path, lexical_score, embedding_rank, (lexical_score * 20 + coalesce((25 - least(embedding_rank, 25)) * 3, 0) + {_SMALL})::BIGINT AS relevance FROM m",
    "file_languages": f"WITH {_FILE} SELECT coalesce(language, 'other') AS language, count(*) AS n, sum(size_bytes)::BIGINT AS size_bytes, count(*) FILTER ({_ISTEST.format('path')}) AS tests FROM fi GROUP BY 1",
    "risk_signals": f"WITH {_SYM}, {_REF}, f AS (SELECT target_id, count(DISTINCT path) AS files FROM ref GROUP BY 1), s AS (SELECT symbol_id, CASE WHEN symbol_id % 50 = 0 THEN 9 ELSE symbol_id % 5 END AS par, line_end - line_start + 1 + CASE WHEN symbol_id % 40 = 0 THEN 120 ELSE 0 END AS span, coalesce(files, 0) AS files FROM sym LEFT JOIN f ON target_id = symbol_id), "
    "o AS (SELECT count(*) FILTER (span >= 80) AS large, max(span) FILTER (span >= 80) AS widest, count(*) FILTER (par >= 5) AS long, max(par) AS most, count(*) FILTER (files >= 3) AS used, max(files) AS mf, count(*) FILTER (files = 0) AS unused FROM s), "
    "n AS (SELECT path, 'src/' || target_id AS tp, count(*) AS c FROM ref GROUP BY kind, path, target_id), m AS (SELECT (SELECT count(*) FROM n) AS refs, count(DISTINCT f) AS files FROM (SELECT path AS f FROM n UNION ALL SELECT tp FROM n)) "
    "SELECT 'large_symbol' AS kind, CASE WHEN widest >= 200 THEN 'high' ELSE 'medium' END AS severity, (690 + least(widest, 250) + 15 * large)::BIGINT AS score, large AS n FROM o WHERE large > 0 UNION ALL SELECT 'long_parameter_list', CASE WHEN most >= 8 THEN 'medium' ELSE 'low' END, (650 + 10 * most + 10 * long)::BIGINT, long FROM o WHERE long > 0 UNION ALL SELECT 'high_fan_in', CASE WHEN mf >= 6 THEN 'high' ELSE 'medium' END, (700 + 20 * mf + 10 * used)::BIGINT, used FROM o WHERE used > 0 "
    "UNION ALL SELECT 'unreferenced_private_symbol', 'low', (520 + 15 * unused)::BIGINT, unused FROM o WHERE unused > 0 UNION ALL SELECT 'refactor_surface', CASE WHEN files >= 5 OR refs >= 8 THEN 'high' ELSE 'medium' END, (700 + files * 25 + refs * 10)::BIGINT, files FROM m WHERE files >= 3",
}
