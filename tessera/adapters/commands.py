"""The engine over a store: commands, tools for agents (JSON-RPC) and an HTTP interface, all through one table of actions.

``python -m tessera.adapters.commands STORE COMMAND ...`` prints text, or JSON with ``--json``.
"""

from __future__ import annotations

import argparse
import hmac
import json
import os
import re
import subprocess
import sys
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.adapters.store import Store, install
from tessera.adapters.tools import clamp
from tessera.functions import text as X
from tessera.operators import code, context, edits, evaluation, files, lifecycle, moves, recall, replication, sessions
from tessera.operators import tasks as T
from tessera.operators.lifecycle import now_ms
from tessera.sources import workspace as W
from tessera.sources.remote import RemoteStore


MOST_DIAGNOSTICS = 20  # that one command's output leaves


class Engine:
    """Actions on one workspace and its store; each returns what JSON can hold."""

    def __init__(self, spark: SparkSession, store: str | RemoteStore, root: str = ".", clock: Callable[[], int] = now_ms) -> None:
        """``store`` is a folder, or a store elsewhere of which all that only reads can be asked."""
        self.spark, self.store, self.root, self.clock = spark, Store(spark, store) if isinstance(store, str) else store, root, clock

    # --- facts
    def init(self) -> dict:
        done = self.store.migrate()
        self.store.register_project(Path(self.root).resolve().name, str(Path(self.root).resolve()), self.clock())
        return {"created": done}

    def remember(self, text: str, confidence: float | None = 1.0, sensitivity: str = "normal") -> dict:
        return {"id": self.store.remember(text, confidence, sensitivity, at_ms=self.clock())}

    def _recalled(self, query: str, limit: int) -> DataFrame:
        docs = self.store.read("memories").where("valid_to is null").select("id", "kind", "text", "created_at_ms")
        q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return recall.blend(docs, q, recall.bm25(docs, q, max(limit, recall.POOL)), limit=limit).join(docs, "id")

    def recall(self, query: str, limit: int | None = None) -> list:
        return _rows(self._recalled(query, clamp("recall", limit)).orderBy("rank").select("id", "text", "score"))

    def forget(self, query: str, limit: int | None = None) -> dict:
        return {"forgotten": self.store.forget(query, clamp("forget", limit), self.clock())}

    def improve(self) -> dict:
        return _rows(lifecycle.maintenance(self.store.read("memories")))[0]

    # --- sessions
    def session_start(self, task: str) -> dict:
        return {"session": self.store.start_session(task, self.clock())}

    def session_event(self, kind: str, detail: str) -> dict:
        return {"recorded": self.store.record_event(kind, detail, self.clock())}

    def session_end(self, summary: str | None = None) -> dict:
        return {"session": self.store.end_session(summary, self.clock())}

    def session_promote(self) -> dict:
        return {"memory": self.store.promote(self.clock())}

    def run(self, command: list[str]) -> dict:
        """Runs a command, keeps its end as an event and its diagnostics as rows."""
        got = W.capture(command)
        text = f"{got['command']} -> {got['status']}: {got['stderr'] or got['stdout']}"
        self.store.record_event("command", text, self.clock())
        return {"status": got["status"], "diagnostics": self.observe("\n".join((got["stdout"], got["stderr"])), got["command"])}

    def observe(self, output: str, command: str = "") -> int:
        lines = self.spark.createDataFrame([(command, i, t) for i, t in enumerate(output.split("\n"))], "command string, line long, text string")
        found = code.diagnostics_of(lines).limit(MOST_DIAGNOSTICS)
        at = self.clock()
        told = sessions.normalise_diagnostics(found.withColumns({"source": F.lit("command"), "line_end": F.lit(None).cast("long")}))
        rows = told.select(F.concat(F.lit(f"diag_{at}_"), F.uuid()).alias("id"), F.lit("project_local").alias("project_id"), "source", "path", "line_start", "line_end", "severity", "code", "message", X.redact("command").alias("command"), F.lit(at).alias("created_at_ms"))
        kept = rows.collect()  # as many as the limit
        if kept:
            self.store.append("diagnostics", self.spark.createDataFrame(kept, rows.schema))
        return len(kept)

    def hook(self, event: str, payload: str) -> dict:
        """What an agent tells of its own session."""
        told = W.hook_events(self.spark.createDataFrame([(event, payload)], "event string, payload string")).first()
        if event == "session-start":
            return self.session_start(told["session"] or "agent session")
        if event == "session-end":
            return self.session_end()
        return self.session_event("edit", f"edited {told['path']}") if told["path"] else {"recorded": False}

    # --- code
    def _sources(self) -> DataFrame:
        return W.scan(self.spark, self.root)

    def index(self, paths: list[str] = ()) -> dict:
        changed = self.spark.createDataFrame([(p,) for p in paths], "path string") if paths else None
        return self.store.index(self._sources(), self.clock(), changed)

    def _symbols(self, query: str, limit: int) -> DataFrame:
        s, q = self.store.read("code_symbols"), F.lit(query)
        exact = s.where((F.col("path") == query) | (F.col("name") == query))
        if exact.head(1):
            return exact.orderBy("path", "line_start").limit(limit).withColumn("score", F.lit(0))
        terms = X.query_terms(q)
        s = s.where(X.symbol_prefilter(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), terms))
        score = X.symbol_score(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), terms, q)
        return s.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "path", "line_start").limit(limit)

    def symbols(self, query: str, limit: int | None = None) -> list:
        return _rows(self._symbols(query, clamp("symbols", limit)).select("path", "name", "kind", "line_start", "line_end", "signature"))

    def impact(self, target: str, limit: int | None = None) -> list:
        t = self.store.read("code_symbols").where((F.col("path") == target) | (F.col("name") == target))
        refs = self.store.read("code_references").join(t.select(F.col("path").alias("target_path"), F.col("name").alias("target_name")), ["target_path", "target_name"], "left_semi")
        both = t.select("path", F.lit("defines").alias("role")).unionByName(refs.select("path", F.lit("refers").alias("role"))).distinct()
        return _rows(both.orderBy("role", "path").limit(clamp("impact", limit)))

    def _texts(self) -> dict[str, str]:
        return {r["path"]: r["text"] for r in self._sources().where("text is not null").select("path", "text").collect()}

    def _edit(self, changed: dict[str, str]) -> dict:
        W.write_all(self.root, sorted(changed.items()))
        return {"changed": sorted(changed)}

    def replace_symbol(self, path: str, name: str, body: str) -> dict:
        s = [r for r in _rows(self.store.read("code_symbols").where((F.col("path") == path) & (F.col("name") == name)))]
        if len(s) != 1:
            raise edits.EditError("no such symbol" if not s else "more than one such symbol")
        text = edits.replace_symbol(self._texts()[path], s[0].get("language", ""), name, s[0]["line_start"], s[0]["line_end"], body, s[0]["kind"])
        return self._edit({path: text})

    def rename_symbol(self, path: str, name: str, new_name: str) -> dict:
        out = edits.rename(self._sources(), self.store.read("code_symbols"), self.store.read("code_references"), path, name, new_name)
        return self._edit({r["path"]: r["text"] for r in out.collect()})

    def move_symbol(self, path: str, name: str, destination: str, rewrite: bool = False) -> dict:
        refs = self.store.read("code_references").where((F.col("target_path") == path) & (F.col("target_name") == name)).select("path").distinct()
        symbols = _rows(self.store.read("code_symbols").where(F.col("path").isin(path, destination)))
        return self._edit(moves.move(self._texts(), symbols, [r["path"] for r in refs.collect()], path, name, destination, rewrite=rewrite))

    # --- context, evaluation, replication
    def _known(self, branch: tuple[str, ...], changed: DataFrame) -> T.Known:
        """What the store and the workspace know, as packs need it."""
        read = self.store.read
        symbols, started, events = read("code_symbols"), read("sessions"), read("session_events")
        fact = lambda d, kind, detail, at: d.select(F.col("session_id"), kind.alias("kind"), F.col(detail).alias("detail"), F.col(at).alias("at"))
        told = started.withColumnRenamed("id", "session_id")
        facts = fact(told.where("task is not null"), F.lit("task"), "task", "started_at_ms").unionByName(fact(events, F.col("kind"), "detail", "created_at_ms")).unionByName(fact(told.where("final_summary is not null"), F.lit("summary"), "final_summary", "ended_at_ms"))
        packed = read("context_packs").agg(F.max("updated_at_ms").alias("at")).first()["at"]
        return T.Known(
            symbols=symbols.withColumn("parameters", code.parameter_count("signature").cast("long")),
            files=read("discovered_files").select("path", "size_bytes", "language"),
            references=read("code_references"),
            entities=read("entities"),
            sources=read("sources"),
            edges=read("edges"),
            stored_tests=read("test_mappings").select(F.col("source_path").alias("path"), "test_path", "score", "reason"),
            inline=files.inline_tests(symbols),
            facts=read("memories").where("valid_to is null").select("id", "kind", "text", "created_at_ms"),
            diagnostics=read("diagnostics").select("id", "path", "line_start", "severity", "message", "created_at_ms"),
            session_facts=facts,
            metrics=lambda some: code.body_metrics(self._sources().where("text is not null").join(some.select("path").distinct(), "path", "left_semi"), some),
            modified=W.modified(self.spark, self.root),
            indexed=symbols.select("path", "indexed_at_ms"),
            edits=events.where("kind = 'edit'").select("detail", F.col("created_at_ms").alias("at")),
            changed=changed,
            packed_at_ms=2**62 if packed is None else packed,  # before the first pack nothing is newer than one
            branch=branch,
        )

    def context(self, task: str, budget: int | None = None) -> str:
        """A pack of all nine sections as JSON; kept in the store."""
        n = context.budget(budget)
        branch, changed = W.worktree(self.spark, self.root)
        told = tuple(x for x in (str(self.root), branch["branch"], branch["upstream"]) if x)
        packs = T.Packs(self.spark.createDataFrame([(1, task)], "task_id long, task string"), self._known(told, changed))
        out = context.to_json(task, packs.packs(n), n)
        packs.close()
        if isinstance(self.store, Store):
            self.store.save_pack(task, out, self.clock())
        return out

    def evaluate(self, commits: int = 30, most_files: int = 8, least_hit_rate: float | None = None) -> dict:
        log = self.spark.createDataFrame(list(enumerate(W.git_log(self.root, 4 * commits))), "line long, text string")
        order = {h.split("\x1f")[0]: i for i, h in enumerate(x["text"] for x in log.orderBy("line").collect() if "\x1f" in x["text"])}
        places = self.spark.createDataFrame(list(order.items()), "hash string, place long")
        known = self.store.read("discovered_files").select("path", "size_bytes")
        cases, skipped = evaluation.cases(W.commits(log).join(places, "hash"), known, commits, most_files)
        means = evaluation.means(evaluation.replay(cases, known, self.store.read("code_symbols")))
        if least_hit_rate is not None:
            evaluation.gate(means, least_hit_rate)
        return _rows(means)[0] | {"skipped": {r["reason"]: r["n"] for r in skipped.collect()}}

    def sync(self, operation: str, other: str, dry_run: bool = False) -> list:
        config = replication.Config.read(os.environ)
        if dry_run:
            names = replication.selected(config.classes)
            return _rows(replication.plan({n: self.store.read(n) for n in names}, config.classes))
        return _rows(self.store.synchronise(operation, Store(self.spark, other), config, self.clock()))

    def status(self) -> dict:
        return self.store.status()

    def doctor(self) -> dict:
        """Whether what the engine leans on is there."""
        return {"git": subprocess.run(["git", "--version"], capture_output=True).returncode == 0, "tables": not any(self.store._version(t) is None for t in ("memories", "sessions")), "spark": self.spark.version}


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]


# The tools that agents are offered, with their arguments (a ? for those that may be missing).
TOOLS = {
    "context": ["task", "budget?"], "remember": ["text", "confidence?", "sensitivity?"], "recall": ["query", "limit?"], "status": [], "session_start": ["task"], "session_event": ["kind", "detail"], "session_end": ["summary?"], "index": ["paths?"],
    "symbols": ["query", "limit?"], "impact": ["target", "limit?"], "replace_symbol": ["path", "name", "body"], "rename_symbol": ["path", "name", "new_name"], "move_symbol": ["path", "name", "destination", "rewrite?"], "forget": ["query", "limit?"],
}


def answer(engine: Engine, line: str) -> str | None:
    """The reply to one JSON-RPC request; None for a notification."""
    reply: dict = {"jsonrpc": "2.0", "id": None}
    try:
        request = json.loads(line)
        reply["id"], method, params = request.get("id"), request.get("method"), request.get("params") or {}
        if method == "initialize":
            reply["result"] = {"serverInfo": {"name": "tessera"}, "capabilities": {"tools": {}}}
        elif method == "tools/list":
            reply["result"] = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {a.rstrip("?"): {} for a in args}, "required": [a for a in args if a[-1] != "?"]}} for n, args in TOOLS.items()]}
        elif method == "tools/call":
            name, given = params.get("name"), params.get("arguments") or {}
            if name not in TOOLS:
                raise KeyError(f"no such tool: {name}")
            if missing := [a for a in TOOLS[name] if a[-1] != "?" and a not in given]:
                raise KeyError(f"missing: {', '.join(missing)}")
            reply["result"] = getattr(engine, name)(**{a.rstrip("?"): given[a.rstrip("?")] for a in TOOLS[name] if a.rstrip("?") in given})
        else:
            reply["error"] = {"code": -32601, "message": f"no such method: {method}"}
        if "id" not in request:
            return None
    except json.JSONDecodeError as e:
        reply["error"] = {"code": -32700, "message": str(e)}
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        reply["error"] = {"code": -32602, "message": str(e)}
    return json.dumps(reply)


def serve(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    yield from (r for line in lines if line.strip() and (r := answer(engine, line)) is not None)


def respond(engine: Engine, method: str, path: str, body: str, auth: str | None, token: str | None) -> tuple[int, dict | list]:
    """An HTTP request's status and document. All under /v1 needs the bearer token; without one set, nobody has it."""
    if path.startswith("/v1/"):
        if not token or not hmac.compare_digest((auth or "").encode(), f"Bearer {token}".encode()):
            return 401, {"error": "unauthorized"}
        routes: dict[tuple[str, str], Callable] = {
            ("GET", "/v1/memories"): lambda: _rows(engine.store.read("memories")),
            ("POST", "/v1/memories"): lambda: _apply(engine, {"memories": json.loads(body)["memories"]}),
            ("GET", "/v1/storage"): lambda: {t: [json.loads(r["record"]) for r in replication.encode(t, replication.shared(t, engine.store.read(t))).collect()] for t in replication.TABLES},
            ("POST", "/v1/storage"): lambda: _apply(engine, json.loads(body)),
            ("GET", "/v1/sync/status"): lambda: _rows(replication.plan({t: engine.store.read(t) for t in replication.TABLES}, replication.DEFAULT)),
            ("GET", "/v1/sync/history"): lambda: _rows(replication.history(engine.store.read("sync_runs"), engine.store.read("sync_table_runs"), engine.store.read("sync_table_conflicts"), 20)),
            ("POST", "/v1/sync/push"): lambda: engine.sync("push", json.loads(body)["store"], json.loads(body).get("dry_run", True)),
            ("POST", "/v1/sync/pull"): lambda: engine.sync("pull", json.loads(body)["store"], json.loads(body).get("dry_run", True)),
        }
        if method == "GET" and (asked := re.fullmatch(r"/v1/records/(\w+)\?part=(\d+)&of=(\d+)", path)):
            return _part(engine, asked[1], int(asked[2]), int(asked[3]))
        path = path.split("?")[0]
        if (method, path) in routes:
            try:
                return 200, routes[method, path]()
            except (ValueError, KeyError) as e:
                return 400, {"error": str(e)}
        return (405, {"error": "method_not_allowed"}) if any(p == path for _, p in routes) else (404, {"error": "not_found"})
    path = path.split("?")[0]
    if method != "GET":
        return 405, {"error": "method_not_allowed"}
    return {"/health": (200, {"status": "ok"}), "/status": (200, engine.status())}.get(path, (404, {"error": "not_found"})) if path in ("/health", "/status") else (404, {"error": "not_found"})


def _part(engine: Engine, table: str, part: int, of: int) -> tuple[int, dict]:
    """The records of one part of a table, dealt by their key."""
    if table not in replication.TABLES or not 0 <= part < of:
        return 404, {"error": "not_found"}
    rows = replication.shared(table, engine.store.read(table))
    mine = rows.where(F.pmod(F.xxhash64(*replication.TABLES[table].key), F.lit(of)) == part)
    return 200, {"records": [json.loads(r["record"]) for r in replication.encode(table, mine).collect()]}


def _apply(engine: Engine, tables: dict[str, list]) -> dict:
    """Records of some tables as another store sends them: they win over what is there."""
    done = {}
    for name in (t for t in replication.TABLES if t in tables):
        rows = engine.spark.createDataFrame([(json.dumps(r),) for r in tables[name]], "record string")
        mine = engine.store.read(name)
        parent = replication.TABLES[name].parent
        engine.store.replace(name, replication.push(name, replication.decode(name, rows), mine, engine.store.read(parent[0]) if parent else None))
        done[name] = len(tables[name])
    return done


def listen(engine: Engine, host: str, port: int, token: str | None, most: int = 1 << 20) -> HTTPServer:
    """An HTTP server over ``respond``; requests of more than ``most`` bytes are refused."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            status, doc = (413, {"error": "too_large"}) if n > most else respond(engine, self.command, self.path, self.rfile.read(n).decode(), self.headers.get("Authorization"), token)
            data = json.dumps(doc).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *_) -> None:
            pass

    return HTTPServer((host, port), Handler)


def request_embeddings(url: str, model: str, texts: list[str], width: int, token: str | None = None, send: Callable = urllib.request.urlopen) -> list[list[float]]:
    """Vectors of an OpenAI-style service; an answer of another number or width is an error."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    with send(urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), headers)) as r:
        doc = json.loads(r.read())
    if "error" in doc:
        raise ValueError(f"the service answers: {doc['error']}")
    vectors = [x["embedding"] for x in sorted(doc["data"], key=lambda x: x.get("index", 0))]
    if len(vectors) != len(texts) or any(len(v) != width for v in vectors):
        raise ValueError(f"expected {len(texts)} vectors of {width} numbers")
    return vectors


def render(value) -> str:
    """What a command returns, as text."""
    if isinstance(value, list):
        return "\n".join("  ".join(f"{k}={v}" for k, v in x.items()) if isinstance(x, dict) else str(x) for x in value) or "nothing found"
    return "\n".join(f"{k}: {json.dumps(v) if isinstance(v, (dict, list)) else v}" for k, v in value.items()) if isinstance(value, dict) else str(value)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("store")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, **({"nargs": "+"} if a in ("argv", "words") else {}))
        for o, (kind, default) in options.items():
            c.add_argument("--" + o.replace("_", "-"), **({"action": "store_true"} if kind is bool else {"type": kind, "default": default}))

    for name in ("init", "status", "doctor", "improve", "session-promote", "mcp"):
        add(name)
    add("remember", "words", confidence=(float, 1.0), sensitivity=(str, "normal"))
    for name in ("recall", "forget", "symbols"):
        add(name, "words", limit=(int, None))
    add("context", "words", budget=(int, None), markdown=(bool, False))
    add("index", paths=(str, ""))
    add("impact", "target", limit=(int, None))
    add("replace-symbol", "path", "name", "body")
    add("rename-symbol", "path", "name", "new_name")
    add("move-symbol", "path", "name", "destination", rewrite=(bool, False))
    add("session-start", "words")
    add("session-event", "kind", "words")
    add("session-end", summary=(str, None))
    add("run", "argv")
    add("observe", "output", of=(str, ""))
    add("hook", "event", "payload")
    add("eval", commits=(int, 30), most_files=(int, 8), least_hit_rate=(float, None))
    for name in ("sync-push", "sync-pull"):
        add(name, "other", dry_run=(bool, False))
    add("daemon", host=(str, "127.0.0.1"), port=(int, 7717))
    add("install", "file")
    return p


def dispatch(engine: Engine, a: argparse.Namespace):
    """Runs a parsed command."""
    words = " ".join(getattr(a, "words", []) or [])
    simple = {"init", "status", "doctor", "improve", "session-promote"}
    if a.command in simple:
        return getattr(engine, a.command.replace("-", "_"))()
    if a.command == "context":
        out = engine.context(words, a.budget)
        return context.to_markdown(out) if a.markdown else json.loads(out)
    table = {
        "remember": lambda: engine.remember(words, a.confidence, a.sensitivity), "recall": lambda: engine.recall(words, a.limit), "forget": lambda: engine.forget(words, a.limit), "symbols": lambda: engine.symbols(words, a.limit),
        "index": lambda: engine.index([p for p in a.paths.split(",") if p]), "impact": lambda: engine.impact(a.target, a.limit), "replace-symbol": lambda: engine.replace_symbol(a.path, a.name, a.body),
        "rename-symbol": lambda: engine.rename_symbol(a.path, a.name, a.new_name), "move-symbol": lambda: engine.move_symbol(a.path, a.name, a.destination, a.rewrite), "session-start": lambda: engine.session_start(words),
        "session-event": lambda: engine.session_event(a.kind, words), "session-end": lambda: engine.session_end(a.summary), "run": lambda: engine.run(a.argv), "observe": lambda: {"diagnostics": engine.observe(a.output, a.of)},
        "hook": lambda: engine.hook(a.event, a.payload), "eval": lambda: engine.evaluate(a.commits, a.most_files, a.least_hit_rate), "sync-push": lambda: engine.sync("push", a.other, a.dry_run), "sync-pull": lambda: engine.sync("pull", a.other, a.dry_run),
        "install": lambda: {"installed": install(a.file, [sys.executable, "-m", "tessera.adapters.commands", a.store, "mcp"])},
    }
    return table[a.command]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{a.store}/_warehouse").getOrCreate()
    engine = Engine(spark, a.store, a.root)
    if a.command == "mcp":
        for line in serve(engine, sys.stdin):
            print(line, flush=True)
        return 0
    if a.command == "daemon":
        listen(engine, a.host, a.port, os.environ.get("TESSERA_API_TOKEN")).serve_forever()
        return 0
    try:
        out = dispatch(engine, a)
    except (ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False) if a.json else render(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
