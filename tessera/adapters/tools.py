"""The engine's tools for agents: each takes a session, a folder of tables and arguments, and returns few rows.

``python -m tessera.adapters.tools TABLES TOOL [--query Q] [--limit N]`` prints JSON lines; ``... TABLES serve`` answers
JSON-RPC requests, one a line, on standard input.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import files, graph, memory, recall
from tessera.sources import model as M

# Default and largest number of rows by tool.
LIMITS = {"recall": (10, 50), "forget": (25, 100), "symbols": (25, 100), "impact": (50, 500), "files": (12, 100), "maintenance": (25, 100), "index": (5000, 50_000)}


def clamp(tool: str, limit: int | None) -> int:
    default, most = LIMITS[tool]
    return max(1, min(most, default if limit is None else limit))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return M.active(M.memories(spark, d))


def recall_facts(spark, d, query: str, limit: int) -> DataFrame:
    docs, q = _facts(spark, d), spark.createDataFrame([(0, query)], "query_id long, query string")
    return recall.blend(docs, q, recall.bm25(docs, q, max(limit, recall.POOL)), limit=limit).join(docs.select("id", "kind", "text"), "id").orderBy("rank").select("id", "kind", "score", "text")


def forget_facts(spark, d, query: str, limit: int) -> DataFrame:
    """What would be ended; the caller writes it."""
    return memory.forget(_facts(spark, d), query, limit, 0).select("id", "score")


def rank_symbols(spark, d, query: str, limit: int) -> DataFrame:
    s = M.symbols(spark, d)
    q = F.lit(query)
    score = X.symbol_score(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), X.query_terms(q), q)
    return s.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "path", "line_start").limit(limit).select("path", "name", "kind", "line_start", "score")


def impact_of(spark, d, query: str, limit: int) -> DataFrame:
    s = M.symbols(spark, d)
    t = s.where((F.col("name") == query) | (F.col("path") == query)).select("symbol_id")
    return graph.impact(s, M.references(spark, d), t).orderBy("role", "file").limit(limit)


def rank_files(spark, d, query: str, limit: int) -> DataFrame:
    return files.candidates(M.files(spark, d), query, limit).select("path", "lexical_score", "relevance")


def maintenance(spark, d, query: str, limit: int) -> DataFrame:
    return memory.duplicate_groups(_facts(spark, d)).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").limit(limit).select("n", "first")


TOOLS: dict[str, Callable[..., DataFrame]] = {"recall": recall_facts, "forget": forget_facts, "symbols": rank_symbols, "impact": impact_of, "files": rank_files, "maintenance": maintenance}


def call(spark: SparkSession, d: str, tool: str, query: str = "", limit: int | None = None) -> list[dict]:
    if tool not in TOOLS:
        raise KeyError(f"no such tool: {tool}")
    return [json.loads(r[0]) for r in TOOLS[tool](spark, d, query, clamp(tool, limit)).select(F.to_json(F.struct("*"))).collect()]


def respond(spark: SparkSession, d: str, lines: Iterable[str]) -> Iterator[str]:
    """A response for each request that has an id; notifications get none, broken lines an error."""
    for line in filter(str.strip, lines):
        reply: dict = {"jsonrpc": "2.0", "id": None}
        try:
            request = json.loads(line)
            reply["id"], method, params = request.get("id"), request.get("method"), request.get("params") or {}
            if method == "tools/list":
                reply["result"] = {"tools": [{"name": n, "limit": LIMITS[n][0], "most": LIMITS[n][1]} for n in TOOLS]}
            elif method == "tools/call":
                args = params.get("arguments") or {}
                reply["result"] = {"rows": call(spark, d, params.get("name", ""), str(args.get("query", "")), args.get("limit"))}
            else:
                reply["error"] = {"code": -32601, "message": f"no such method: {method}"}
            if "id" not in request:
                continue
        except json.JSONDecodeError as e:
            reply["error"] = {"code": -32700, "message": str(e)}
        except (KeyError, TypeError, AttributeError) as e:
            reply["error"] = {"code": -32602, "message": str(e)}
        yield json.dumps(reply)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("tables")
    parser.add_argument("tool", choices=[*TOOLS, "serve"])
    parser.add_argument("--query", default="")
    parser.add_argument("--limit", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = respond(spark, args.tables, sys.stdin) if args.tool == "serve" else map(json.dumps, call(spark, args.tables, args.tool, args.query, args.limit))
    for line in out:
        print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
