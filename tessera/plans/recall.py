"""Registered recall, text and memory queries, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import memory, recall
from tessera.sources import model as M
from tessera.sources.scratch import keep

# Corpus words that stand for opposing signals where the corpus has none of the fixed ones.
CORPUS_SIGNALS = [("eronst", "thnded", "eronst_vs_thnded"), ("onnd", "thnt", "onnd_vs_thnt")]


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def _docs(spark, d):
    return M.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") * 1000).alias("created_at_ms"))


def _vectors(spark, d):
    return M.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _query_vectors(spark, d):
    return _vectors(spark, d).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


def recall_bm25(spark, d):
    return recall.bm25(_docs(spark, d), M.query_set(spark, d), 10).select("query_id", "id", "bm25", "fts_rank")


def recall_blend(spark, d):
    docs, q = _docs(spark, d), M.query_set(spark, d)
    return recall.blend(docs, q, recall.bm25(docs, q))


def recall_hybrid(spark, d):
    """Text and vector legs; item i searches with vector i."""
    docs, q = _docs(spark, d), M.query_set(spark, d)
    v = _vectors(spark, d)
    top = recall.vector_top(v, q.join(v, q.query_id == v.id).select("query_id", F.col("embedding").alias("query_vector")))
    return recall.blend(docs, q, recall.bm25(docs, q), top)


def vector_topk(spark, d):
    return recall.vector_top(_vectors(spark, d), _query_vectors(spark, d), 10)


def eval_metrics(spark, d):
    docs, q = _docs(spark, d), M.query_set(spark, d)
    # an item is expected where its whole text stands; that of its inner words which fewest documents have brings the two together
    words = X.tokens("query")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(words)
    wanted = q.select("query_id", F.explode(F.array_distinct(inner)).alias("term"))
    at = docs.select("id", F.explode(F.array_distinct(X.tokens("text"))).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    rare = keep(wanted.join(at.groupBy("term").agg(F.count("*").alias("n")), "term").groupBy("query_id").agg(F.min(F.struct("n", "term")).alias("r")).select("query_id", "r.term"), "rare")
    near = keep(at.join(rare, "term").select("query_id", "id"), "near")  # known to be few, so neither words nor texts are moved for them
    texts = docs.select("id", "text").join(near.select("id").distinct(), "id", "left_semi")
    expected = near.join(texts, "id").join(q, "query_id").where(F.contains("text", F.col("query"))).select("query_id", "id")
    return recall.evaluate(recall.blend(docs, q, recall.bm25(docs, q)), expected)


def term_tokens(spark, d):
    t = M.read(spark, d, "documents").select("doc_id", X.tokens("text").alias("all"))  # a text is split once
    t = t.select("doc_id", "all", X.selective("all").alias("some")).select("doc_id", "all", F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("all")).alias("terms"))
    t = t.select("doc_id", F.size("all").alias("n_tokens"), F.size("terms").alias("n_terms"), F.array_distinct("terms").alias("own"))
    return t.select("doc_id", "n_tokens", "n_terms", F.size("own").alias("n_distinct"), F.size(F.array_except("own", F.array(*map(F.lit, X.STOP_TERMS + X.SIGNAL_TERMS)))).alias("n_meaningful"))


def token_estimate(spark, d):
    return M.read(spark, d, "documents").groupBy("source").agg(F.sum(X.token_estimate("text")).alias("tokens"), F.max(X.token_estimate("text")).alias("largest"))


def redact_documents(spark, d):
    r = M.read(spark, d, "documents").select("doc_id", X.redact("text").alias("r"), "text")
    return r.where("r <> text").select("doc_id", F.length("r").alias("n_chars"), F.md5(F.col("r").cast("binary")).alias("digest"))


def content_keys(spark, d):
    return M.query_set(spark, d).select("query_id", V.content_key("query").alias("content_key"))


def hashed_embedding(spark, d):
    return V.embed_terms(M.query_set(spark, d), "query_id", "query").select("query_id", F.col("index").cast("long").alias("index"), F.round("weight", 6).alias("weight"))


def dup_groups(spark, d):
    return memory.duplicate_groups(M.active(M.memories(spark, d)))


def consolidate_plan(spark, d):
    return memory.consolidation(M.active(M.memories(spark, d)))


def contradictions_corpus(spark, d):
    return memory.contradictions(M.active(M.memories(spark, d)), CORPUS_SIGNALS, digest=True)


def contradiction_classes(spark, d):
    """Conflicts between classes of facts, with how many pairs each stands for."""
    met, members = memory.contradiction_classes(M.active(M.memories(spark, d)), CORPUS_SIGNALS)
    size = members.groupBy(F.col("class").alias("left")).agg(F.count("*").alias("facts"))
    return met.join(size, "left").select("left", "right", "signal", F.md5(F.col("shared").cast("binary")).alias("shared"), "pairs", "facts")


def forget_matches(spark, d):
    return memory.forget(M.active(M.memories(spark, d)), "the garden thnt onnd eronst", 25, 77).select("id", F.col("score").cast("long").alias("score"), "valid_to")


def active_counts(spark, d):
    m = M.memories(spark, d)
    return m.groupBy("kind").agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull()).alias("active"), F.round(F.avg("confidence"), 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (recall_bm25, recall_blend, recall_hybrid, vector_topk, eval_metrics, term_tokens, token_estimate, redact_documents, content_keys, hashed_embedding, dup_groups, consolidate_plan, contradictions_corpus, contradiction_classes, forget_matches, active_counts)
}

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_-]+'), lambda t: t <> '')"
_TERMS = "(CASE WHEN len(list_filter(" + _TOK + ", lambda t: strlen(t) > 2)) > 0 THEN list_filter(" + _TOK + ", lambda t: strlen(t) > 2) ELSE " + _TOK + " END)"


def tok(c: str) -> str:
    return _TOK.format(c)


def terms(c: str) -> str:
    return _TERMS.format(c)


_BM25 = f"""
q AS (SELECT item_id AS query_id, text AS query, unnest(list_distinct({terms('text')})) AS term FROM benchmark),
d AS (SELECT doc_id AS id, text, {tok('text')} AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS average FROM d),
p AS (SELECT id, len AS length, term, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query_id, p.id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS bm25
       FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY query_id, p.id),
fts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS fts_rank FROM sc)"""
_BLEND = f"""
hits AS (SELECT query_id, id, min(bm25) AS bm25, min(vr) AS vr FROM (SELECT query_id, id, bm25, NULL::BIGINT AS vr FROM fts WHERE fts_rank <= 50 {{more}}) GROUP BY ALL),
sco AS (SELECT query_id, id, round(10.0 * (CASE WHEN bm25 IS NULL THEN 0 ELSE (CASE WHEN contains(lower(d.text), lower(b.text)) THEN 10 ELSE 0 END)
        + len(list_filter({terms('b.text')}, lambda t: contains(lower(d.text), t))) END) + coalesce(1 / (1 + abs(bm25)), 0.0) + coalesce(1.0 / vr, 0.0), 6) AS score
        FROM hits JOIN documents d ON d.doc_id = hits.id JOIN benchmark b ON b.item_id = hits.query_id),
blend AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id * 1000 DESC, id) AS rank FROM sco)"""
_COS = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT id, CASE WHEN list_dot_product(e, e) = 0 THEN e ELSE list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) END AS u FROM v)"""
_SQL_REDACT = "text"
for _p, _r in X.REDACTIONS:
    _SQL_REDACT = f"regexp_replace({_SQL_REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '{_r.replace('$1', chr(92) + '1')}', 'g')"


def _contradiction_sql(facts: str, signals, shared: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOP_TERMS + X.SIGNAL_TERMS)
    return f"""
WITH f AS ({facts}), t AS (SELECT id, created_at_ms, {terms('text')} AS a FROM f),
m AS (SELECT id, created_at_ms, a, list_distinct(list_filter(a, lambda x: NOT list_contains([{stop}], x))) AS m FROM t),
s(i, l, r, name) AS (VALUES {_values([(i, *x) for i, x in enumerate(signals)])}),
p AS (SELECT x.id AS xi, x.created_at_ms AS xt, y.id AS yi, y.created_at_ms AS yt, i, name, list_sort(list_intersect(x.m, y.m)) AS shared
      FROM s JOIN m x ON list_contains(x.a, s.l) JOIN m y ON list_contains(y.a, s.r) AND x.id <> y.id WHERE len(list_intersect(x.m, y.m)) >= 2),
o AS (SELECT CASE WHEN xt > yt OR (xt = yt AND xi < yi) THEN xi ELSE yi END AS newer, CASE WHEN xt > yt OR (xt = yt AND xi < yi) THEN yi ELSE xi END AS older, i, name, array_to_string(shared, ' ') AS shared FROM p)
SELECT newer, older, min_by(name, i) AS signal, {shared} AS shared FROM o GROUP BY newer, older"""


def _class_sql(facts: str, signals) -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOP_TERMS + X.SIGNAL_TERMS)
    return f"""
WITH f AS ({facts}), t AS (SELECT id, {terms('text')} AS a FROM f),
m AS (SELECT id, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains([{stop}], x)))) AS m, list_filter([{', '.join(f"CASE WHEN list_contains(a, '{w}') THEN {2 * i + k} END" for i, (x, y, _) in enumerate(signals) for k, w in ((0, x), (1, y)))}], lambda z: z IS NOT NULL) AS sides FROM t),
c AS (SELECT min(id) AS name, count(*) AS n, m, sides FROM m WHERE len(sides) > 0 GROUP BY m, sides),
s(i, name) AS (VALUES {_values([(i, x) for i, (*_, x) in enumerate(signals)])}),
p AS (SELECT x.name AS "left", y.name AS "right", min_by(s.name, i) AS signal, md5(any_value(array_to_string(list_sort(list_intersect(x.m, y.m)), ' '))) AS shared, any_value(CASE WHEN x.name = y.name THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END)::BIGINT AS pairs, any_value(x.n) AS facts
      FROM s JOIN c x ON list_contains(x.sides, 2 * i) JOIN c y ON list_contains(y.sides, 2 * i + 1) WHERE len(list_intersect(x.m, y.m)) >= 2 GROUP BY x.name, y.name)
SELECT * FROM p WHERE pairs > 0"""


_ACTIVE = "SELECT doc_id AS id, doc_id * 1000 AS created_at_ms, text FROM documents WHERE doc_id % 10 <> 0"
_NORM = r"lower(regexp_replace(trim(text, E' \t\n\r\x0b\x0c'), '[ \t\n\x0b\f\r]+', ' ', 'g'))"
_FNV = "list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(1, strlen(hex(encode({0}))) // 2 + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::INT::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 435 + (xor(h::UBIGINT, b::UBIGINT)::HUGEINT % 16777216) * 1099511627776) % 18446744073709551616)"
ORACLES = {
    "recall_bm25": f"WITH {_BM25} SELECT query_id, id, bm25, fts_rank FROM fts WHERE fts_rank <= 10",
    "recall_blend": f"WITH {_BM25}, {_BLEND.replace('{more}', '')} SELECT query_id, id, score, rank FROM blend WHERE rank <= 10",
    "recall_hybrid": f"WITH {_BM25}, {_COS}, vt AS (SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.id) AS vr FROM u a, u b WHERE a.id IN (SELECT item_id FROM benchmark)), "
    + _BLEND.replace('{more}', "UNION ALL SELECT query_id, id, NULL, vr FROM vt WHERE vr <= 50")
    + " SELECT query_id, id, score, rank FROM blend WHERE rank <= 10",
    "vector_topk": f"WITH {_COS}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.u, b.u), 6) AS score FROM u a, u b WHERE a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS vector_rank FROM s) SELECT * FROM r WHERE vector_rank <= 10",
    "eval_metrics": f"WITH {_BM25}, {_BLEND.replace('{more}', '')}, e AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), w AS (SELECT query_id, count(*) AS wanted FROM e GROUP BY 1), h AS (SELECT e.query_id, count(*) AS found, min(rank) AS first FROM blend JOIN e USING (query_id, id) WHERE rank <= 10 GROUP BY 1) "
    "SELECT count(*) AS cases, round(avg(coalesce(found / wanted, 0)), 6) AS recall, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM w LEFT JOIN h USING (query_id)",
    "term_tokens": f"WITH t AS (SELECT doc_id, {tok('text')} AS a, {terms('text')} AS s FROM documents) SELECT doc_id, len(a) AS n_tokens, len(s) AS n_terms, len(list_distinct(s)) AS n_distinct, len(list_filter(list_distinct(s), lambda x: NOT list_contains([{', '.join(repr(w) for w in X.STOP_TERMS + X.SIGNAL_TERMS)}], x))) AS n_meaningful FROM t",
    "token_estimate": r"WITH t AS (SELECT source, greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')), ceil(length(coalesce(text, '')) / 4)::BIGINT, 1) AS n FROM documents) SELECT source, sum(n)::BIGINT AS tokens, max(n) AS largest FROM t GROUP BY source",
    "redact_documents": f"WITH r AS (SELECT doc_id, text, {_SQL_REDACT} AS r FROM documents) SELECT doc_id, length(r) AS n_chars, md5(r) AS digest FROM r WHERE r <> text",
    "content_keys": f"SELECT item_id AS query_id, lpad(lower(to_hex({_FNV.format('text')}::UBIGINT)), 16, '0') AS content_key FROM benchmark",
    "hashed_embedding": f"WITH t AS (SELECT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark), h AS (SELECT query_id, {_FNV.format('term')} AS h FROM t), w AS (SELECT query_id, (h % 1536)::BIGINT AS index, (CASE WHEN h >= 9223372036854775808 THEN -1.0 ELSE 1.0 END) * (1 + ((h // 4294967296) % 256)::DOUBLE / 255.0) AS w FROM h), s AS (SELECT query_id, index, sum(w) AS v FROM w GROUP BY ALL HAVING sum(w) <> 0) SELECT query_id, index, round(v / sqrt(sum(v * v) OVER (PARTITION BY query_id)), 6) AS weight FROM s",
    "dup_groups": f"WITH f AS ({_ACTIVE}) SELECT * FROM (SELECT sha256({_NORM}) AS key, count(*) OVER (PARTITION BY {_NORM}) AS n, id FROM f) WHERE n > 1",
    "consolidate_plan": f"WITH f AS ({_ACTIVE}), w AS (SELECT id, first_value(id) OVER w AS superseded_by, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY {_NORM} ORDER BY created_at_ms DESC, id DESC)) SELECT id, superseded_by FROM w WHERE n > 1",
    "contradictions_corpus": _contradiction_sql(_ACTIVE, CORPUS_SIGNALS, "md5(min_by(shared, i))"),
    "contradiction_classes": _class_sql(_ACTIVE, CORPUS_SIGNALS),
    "forget_matches": f"WITH f AS ({_ACTIVE}), s AS (SELECT id, created_at_ms, len(list_filter({terms(chr(39) + 'the garden thnt onnd eronst' + chr(39))}, lambda t: contains(lower(text), t))) + CASE WHEN contains(lower(text), 'the garden thnt onnd eronst') THEN 10 ELSE 0 END AS score FROM f) SELECT id, score, '77' AS valid_to FROM s WHERE score > 0 ORDER BY score DESC, created_at_ms DESC, id LIMIT 25",
    "active_counts": "WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT source AS kind, count(*) AS facts, count(*) FILTER (doc_id % 10 <> 0) AS active, round(avg(CASE WHEN q = 0 THEN 0.5 ELSE 1.0 END), 6) AS confidence FROM documents LEFT JOIN l USING (doc_id) GROUP BY source",
}
