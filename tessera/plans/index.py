"""Registered queries over stored indexes: text recall from postings, vector search through an inverted file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import containment, embeddings, recall, sessions, textindex, vectorindex
from tessera.plans.recall import ORACLES as _RECALL
from tessera.plans.recall import _docs, _query_vectors, _vectors
from tessera.plans.source import _PP
from tessera.plans.store import ORACLES as _STORE
from tessera.sources import model as M
from tessera.sources import remote
from tessera.sources.scratch import folder

LEAST_RECALL = 0.9


def _folder(spark, name):
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _earlier(docs):
    """The documents as they were once: a third not there yet, a fifth with another text, some that are gone by now."""
    text = F.when(F.col("id") % 5 == 0, F.concat(F.lit("once "), F.upper("text"))).otherwise(F.col("text"))
    old = docs.where("id % 3 <> 0").select("id", text.alias("text"))
    return old.unionByName(docs.where("id % 7 = 1").select((-1 - F.col("id")).alias("id"), "text"))


def stored_recall(spark, d):
    """Recall from an index that is stored, read, brought up to date with all documents, and stored again."""
    docs, one, two = _docs(spark, d).select("id", "text"), _folder(spark, "index"), _folder(spark, "index")
    textindex.build(_earlier(docs)).write(one)
    textindex.update(textindex.read(spark, one), docs).write(two)
    return textindex.search(textindex.read(spark, two), M.query_set(spark, d), 10).select("query_id", "id", "bm25", "fts_rank")


def index_changes(spark, d):
    """What an update of that index reads and forgets."""
    docs = _docs(spark, d).select("id", "text")
    due, gone = textindex.changes(textindex.build(_earlier(docs)), docs)
    return due.select(F.lit("read").alias("what"), "id").unionByName(gone.select(F.lit("forget").alias("what"), "id"))


def _searched(spark, d):
    where = _folder(spark, "vectors")
    vectorindex.build(_vectors(spark, d)).write(where)
    return vectorindex.search(vectorindex.read(spark, where), _query_vectors(spark, d), 10, probes=20)


def vector_index_topk(spark, d):
    """Every twentieth vector against the stored inverted file; not all cells are probed."""
    return _searched(spark, d)


def vector_index_recall(spark, d):
    """Whether the inverted file finds nine tenths of what the exact search finds."""
    want = vectorindex.exact(_vectors(spark, d), _query_vectors(spark, d), 10)
    hit = want.join(_searched(spark, d).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= LEAST_RECALL * F.count("*")).alias("reached"))


def paths_in_details(spark, d):
    """Which session details contain which paths of the project."""
    e = M.edit_events(spark, d)
    return containment.containing(e.select(F.col("at").alias("key"), F.col("detail").alias("text")), M.project_paths(spark, d).select(F.col("path").alias("needle")))


def remote_recall(spark, d):
    """Recall over documents that come as records, in several files, through the data source."""
    docs, where = _docs(spark, d), _folder(spark, "records")
    docs.select(F.to_json(F.struct("id", "text", "created_at_ms")).alias("value")).repartition(5).write.text(where)
    far = remote.records(spark, "id long, text string, created_at_ms long", folder=where)
    return recall.bm25(far, M.query_set(spark, d), 10).select("query_id", "id", "bm25", "fts_rank")


def remote_diagnostics(spark, d):
    """The newest diagnostics for a query, of records through the data source."""
    where = _folder(spark, "records")
    M.diagnostics(spark, d).select(F.to_json(F.struct("*")).alias("value")).repartition(3).write.text(where)
    g = remote.records(spark, "id long, path string, severity string, message string, created_at_ms long", folder=where)
    some = g.select("path").where("path like '%7.rs'").distinct()
    return sessions.diagnostic_rank(g, "purchase error user", some, 1000, 25).select("id", "path", "severity", F.col("score").cast("long").alias("score"))


def measured(texts):
    """A provider that measures: characters and blanks."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def embeddings_refreshed(spark, d):
    """The table of embeddings after a third of the texts has changed; what was not embedded anew says -1."""
    docs = _docs(spark, d).select("id", "text")
    was = docs.withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" once"))).otherwise(F.col("text")))
    was = was.unionByName(docs.where("id % 7 = 1").select((-1 - F.col("id")).alias("id"), "text"))
    stored = embeddings.keyed(was, "m", 2).drop("text").withColumn("embedding", F.array(F.lit(-1.0), F.lit(0.0)).cast("array<float>"))
    out = embeddings.refreshed(stored, docs, measured, "m", 2)
    return out.select("id", F.get("embedding", F.lit(0)).cast("double").alias("characters"), F.get("embedding", F.lit(1)).cast("double").alias("blanks"))


QUERIES = {f.__name__: f for f in (stored_recall, index_changes, vector_index_topk, vector_index_recall, paths_in_details, remote_recall, remote_diagnostics, embeddings_refreshed)}

_WAS = "w AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'once ' || upper(text) ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 7 = 1)"
EDITED = "es AS (SELECT 'edited ' || CASE s_suppkey % 3 WHEN 0 THEN 'pkg/supplier_' || s_suppkey || '.go again' WHEN 1 THEN '\"./pkg/supplier_' || s_suppkey || '.go\"+x' ELSE 'copy of(pkg/supplier_' || s_suppkey || '.go.bak)' END AS detail, s_suppkey * 200000 AS \"at\" FROM supplier)"
ORACLES = {
    "stored_recall": _RECALL["recall_bm25"],
    "embeddings_refreshed": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN length(coalesce(text, ''))::DOUBLE ELSE -1.0::DOUBLE END AS characters, CASE WHEN doc_id % 3 = 0 THEN (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE ELSE 0.0::DOUBLE END AS blanks FROM documents",
    "remote_recall": _RECALL["recall_bm25"],
    "remote_diagnostics": _STORE["diagnostic_rank"],
    "index_changes": f"WITH {_WAS}, n AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), o AS (SELECT id, coalesce(text, '') AS text FROM w) SELECT 'read' AS what, id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.text = n.text) UNION ALL SELECT 'forget', id FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.id = n.id AND o.text = n.text)",
    "vector_index_recall": "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0",
    "paths_in_details": f"WITH {_PP}, {EDITED} SELECT es.\"at\" AS key, path AS needle FROM es JOIN (SELECT DISTINCT path FROM pp) ON contains(detail, path)",
}
