"""The store, commands, tools, HTTP, moves, parsers and streams, each against its worked example."""

import datetime
import json
import subprocess
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql.functions import col as spark_col

from tessera.adapters import commands
from tessera.adapters.store import Conflict, Store, install
from tessera.functions import paths as P
from tessera.functions import vectors as V
from tessera.operators import code, edits, lifecycle, moves, replication
from tessera.sources import remote
from tessera.sources import workspace as W
from tessera.sources.remote import RemoteStore
from tessera.streaming import background, events


def _pick(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# --- parsers
FILES = [
    ("a.rs", "rust", "impl<T> Area for Shape<T> {\n    fn area(&self) -> u32 { 1 }\n}\nimpl Shape {\n}\n"),
    ("a.ts", "typescript", "export class Cart {\n  async total(x: number): Promise<number> {\n    if (x) {\n    }\n  }\n}\nexport const go = async (a: string) => a;\nconst plain = 3;\n"),
    ("a.js", "javascript", "exports.load = function () {};\nmodule.exports.save = 1;\nconst run = x => x;\n"),
    ("A.java", "java", "public @interface Mark {\n}\npublic class A {\n  private static int sum(int a, int b) throws E {\n    return twice(a);\n  }\n}\n"),
    ("A.kt", "kotlin", "annotation class Mark\nenum class Tint { RED }\ntypealias Id = String\nfun String.shout(): String = this\n"),
    ("A.swift", "swift", "actor Bank {\n}\nextension Bank {\n}\ntypealias Id = String\nprotocol Safe {\n}\n"),
]


def test_declarations_of_languages(spark):
    got = code.declarations(spark.createDataFrame(FILES, "path string, language string, text string"))
    assert set(_pick(got, "path", "name", "kind")) == {
        ("a.rs", "Shape", "impl"), ("a.rs", "area", "function"), ("a.ts", "Cart", "class"), ("a.ts", "total", "function"), ("a.ts", "go", "function"), ("a.js", "load", "function"), ("a.js", "save", "function"), ("a.js", "run", "function"),
        ("A.java", "Mark", "annotation"), ("A.java", "A", "class"), ("A.java", "sum", "function"), ("A.kt", "Mark", "annotation"), ("A.kt", "Tint", "enum"), ("A.kt", "Id", "type"), ("A.kt", "shout", "function"),
        ("A.swift", "Bank", "actor"), ("A.swift", "Bank", "extension"), ("A.swift", "Id", "type"), ("A.swift", "Safe", "protocol"),
    }


# --- small functions
def test_paths_as_git_writes_them():
    assert P.unquote("plain") == "plain" and P.unquote(r'"tab\there \"x\" \303\251"') == 'tab\there "x" é'
    assert W.branch("## main...origin/main [ahead 2, behind 1]") == {"branch": "main", "upstream": "origin/main", "ahead": 2, "behind": 1}
    assert W.branch("## HEAD (no branch)")["branch"] is None and W.branch("## fix")["branch"] == "fix"


def test_blobs():
    assert V.from_blob(V.to_blob([1.5, -2.0], 4)) == [1.5, -2.0, 0.0, 0.0] and len(V.to_blob([0.0] * 2000)) == 4 * 1536
    with pytest.raises(ValueError):
        V.from_blob(b"abc")


def test_staged_writes_are_all_or_none(tmp_path):
    W.write_all(str(tmp_path), [("a.txt", "1"), ("b/c.txt", "2")])
    assert (tmp_path / "b/c.txt").read_text() == "2"
    (tmp_path / "d").write_text("a file, no folder")
    with pytest.raises(OSError):
        W.write_all(str(tmp_path), [("a.txt", "new"), ("d/e.txt", "x")])
    assert (tmp_path / "a.txt").read_text() == "1" and not list(tmp_path.glob("**/*.staging"))


# --- edits and moves
def symbol(path, name, language, a, z, kind="function"):
    return {"path": path, "name": name, "kind": kind, "language": language, "line_start": a, "line_end": z}


MOVES = [
    ("rust", {"src/a.rs": "pub fn keep() {}\n\npub fn go() {}\n", "src/m.rs": "use crate::a::{go, keep};\nfn f() { go(); }\n"}, "src/a.rs", (3, 3), "src/b/c.rs", "src/m.rs", "use crate::a::{keep};\nuse crate::b::c::go;\nfn f() { go(); }\n"),
    ("python", {"pkg/a.py": "def go():\n    return 1\n", "m.py": "from pkg.a import go, x\ngo()\n"}, "pkg/a.py", (1, 2), "pkg/b.py", "m.py", "from pkg.a import x\nfrom pkg.b import go\ngo()\n"),
    ("typescript", {"web/a.ts": "export function go() {\n}\n", "web/in/m.ts": "import { go, x } from '../a';\ngo();\n"}, "web/a.ts", (1, 2), "web/b.ts", "web/in/m.ts", "import { x } from '../a';\nimport { go } from '../b';\ngo();\n"),
    ("javascript", {"a.js": "function go() {\n}\n", "m.js": 'const { go } = require("./a");\ngo();\n'}, "a.js", (1, 2), "b.js", "m.js", 'const { go } = require("./b");\ngo();\n'),
    ("go", {"go.mod": "module ex.org/m\n", "a/a.go": "package a\n\nfunc Go() {}\n", "m/m.go": 'package m\n\nimport "ex.org/m/a"\n\nfunc f() { a.Go() }\n'}, "a/a.go", (3, 3), "b/b.go", "m/m.go", 'package m\n\nimport "ex.org/m/b"\n\nfunc f() { b.Go() }\n'),
    ("java", {"src/p/A.java": "package p;\nclass Go {}\n", "src/p/M.java": "package p;\nclass M { Go go; }\n"}, "src/p/A.java", (2, 2), "src/q/Go.java", "src/p/M.java", "package p;\n\nimport q.Go;\nclass M { Go go; }\n"),
    ("kotlin", {"src/p/A.kt": "package p\nclass Go\n", "src/r/M.kt": "package r\nimport p.Go\nval g = Go()\n"}, "src/p/A.kt", (2, 2), "src/q/B.kt", "src/r/M.kt", "package r\nimport q.Go\nval g = Go()\n"),
    ("swift", {"Sources/A/a.swift": "struct Go {}\n", "Sources/M/m.swift": "import A\nlet g = Go()\n"}, "Sources/A/a.swift", (1, 1), "Sources/B/b.swift", "Sources/M/m.swift", "import B\nimport A\nlet g = Go()\n"),
]


@pytest.mark.parametrize("language,texts,path,at,to,user,want", MOVES, ids=[m[0] for m in MOVES])
def test_moves_rewrite_imports(language, texts, path, at, to, user, want):
    name = "Go" if language in ("go", "java", "kotlin", "swift") else "go"
    got = moves.move(texts, [symbol(path, name, language, *at)], [user], path, name, to, rewrite=True)
    assert got[user] == want and name in got[to] and name not in got[path].replace("package", "")
    assert user not in moves.move(texts, [symbol(path, name, language, *at)], [user], path, name, to)


def test_edits_are_refused():
    s = [symbol("a.py", "f", "python", 1, 1), symbol("b.py", "f", "python", 1, 1)]
    for to, name in (("a.py", "f"), ("b.py", "f"), ("c.py", "g"), (" ", "f")):
        with pytest.raises(edits.EditError):
            moves.move({"a.py": "def f(): pass\n", "b.py": ""}, s, [], "a.py", name, to)
    with pytest.raises(edits.EditError):
        edits.replace_symbol("def f():\n    pass\n", "python", "f", 1, 2, "class f:\n    pass", "function")
    assert edits.replace_symbol("class A:\n    def f(self):\n        pass\n", "python", "f", 2, 3, "def f(self):\n    return 1", "function") == "class A:\n    def f(self):\n        return 1\n"


# --- sessions and replication
def plain_log(rows):
    stack, out = {}, {}
    for p, at, _, action, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        mine, open_ = out.setdefault(p, []), stack.setdefault(p, [])
        if action == "start":
            mine.append([at, None, 0])
            open_.append(mine[-1])
        elif open_ and action == "end":
            open_.pop()[1] = at
        elif open_:
            open_[-1][2] += 1
    return sorted((p, i, a, z, n) for p, ss in out.items() for i, (a, z, n) in enumerate(ss))


COMMANDS = [(f"p{i % 3}", i * 7 % 50, i, ["start", "event", "end", "event", "event", "start", "end"][i % 7], "token=abcdef99 x") for i in range(60)]
LOG_SCHEMA = "project string, at long, place long, action string, detail string"


def test_session_log(spark):
    got = lifecycle.session_log(spark.createDataFrame(COMMANDS, LOG_SCHEMA)).collect()
    assert sorted((r["project"], r["session"], r["started_at_ms"], r["ended_at_ms"], r["events"]) for r in got) == plain_log(COMMANDS)
    assert {r["summary"] for r in got if r["summary"]} == {"token=[REDACTED] x"}


def test_configuration():
    assert replication.Config.read({}).mode == "local" and replication.classes("none") == [] and replication.selected(["memories"]) == ["projects", "memories"]
    for bad in ({"TESSERA_STORAGE_MODE": "hybrid"}, {"TESSERA_STORAGE_MODE": "odd"}, {"TESSERA_SYNC_CLASSES": "odd"}):
        with pytest.raises(ValueError):
            replication.Config.read(bad)


def test_strict_codec(spark):
    rows = spark.createDataFrame([("a", "file", "x", 5)], replication.TABLES["sources"].schema)
    assert _pick(replication.decode("sources", replication.encode("sources", rows)), "id", "kind", "locator", "created_at_ms") == [("a", "file", "x", 5)]
    with pytest.raises(Exception, match="MALFORMED"):
        replication.decode("sources", spark.createDataFrame([('{"id": "a", "created_at_ms": "soon"}',)], "record string")).collect()


def test_synthesiser_may_fail():
    assert lifecycle.synthesised("t", "f" * 20_000, lambda t, f: f"{len(f)} " + "x" * 3000) == ("12000 " + "x" * 3000)[:2000]
    assert lifecycle.synthesised("t", "f", lambda t, f: 1 / 0) is None and lifecycle.synthesised("t", "f", None) is None


# --- the engine over a workspace
@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    (root / "src").mkdir()
    (root / "src/base.py").write_text("def helper():\n    return 1\n\n\ndef other():\n    return 2\n")
    (root / "src/main.py").write_text("from base import helper\n\n\ndef start():\n    return helper()\n")
    (root / "tests").mkdir()
    (root / "tests/test_base.py").write_text("def test_it():\n    pass\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "feat(base): add helper base")
    ticks = iter(range(1_000, 10**6))
    e = commands.Engine(spark, str(tmp_path_factory.mktemp("store")), str(root), lambda: next(ticks))
    assert len(e.init()["created"]) == 12 and e.init()["created"] == []
    e.index()
    return e


def test_index_symbols_and_context(engine):
    assert [s["name"] for s in engine.symbols("helper")] == ["helper"] and {r["path"] for r in engine.impact("helper")} == {"src/base.py", "src/main.py"}
    engine.remember("the base helper is slow")
    doc = json.loads(engine.context("base helper", 2000))
    assert doc["relevant_files"][0]["label"] == "src/base.py" and doc["relevant_memories"] and {c["source_type"] for c in doc["citations"]} >= {"file", "symbol", "memory", "graph", "test", "risk"}
    assert [x["label"] for x in doc["affected_tests"]] == ["tests/test_base.py"] and any("src/main.py" in x["label"] for x in doc["graph_neighbors"])
    assert "## Relevant files" in commands.context.to_markdown(json.dumps(doc)) and engine.store.read("context_packs").count() == 1
    with pytest.raises(ValueError):
        engine.context("x", 10)
    assert engine.evaluate(5)["cases"] == 1


def test_facts_and_sessions(engine):
    with pytest.raises(ValueError):
        engine.remember("  ")
    engine.remember("token=abcdef123 opens the door", 0.5)
    assert engine.recall("door")[0]["text"].endswith("door") and len(engine.forget("door")["forgotten"]) == 1 and engine.improve()["facts"] >= 1
    assert not engine.session_event("note", "nobody hears")["recorded"]
    engine.session_start("fix")
    assert engine.hook("post", '{"tool_input":{"file_path":"src/base.py"}}')["recorded"] and engine.run(["git", "no-such-thing"])["status"] != 0
    assert engine.observe("src/base.py:3:1: error: broken password=hunter2222", "run --token abcd1234") == 1 and engine.observe("all is well") == 0
    seen = engine.store.read("diagnostics").where("path = 'src/base.py'").collect()
    assert [(r["source"], r["severity"], r["line_start"]) for r in seen] == [("command", "error", 3)] and all("[REDACTED]" in r[c] for r in seen for c in ("message", "command"))
    told = json.loads(engine.context("fix the broken base", 4000))
    assert told["diagnostics"] and told["recent_sessions"] and {x["citation_id"] for x in told["risk_signals"]} >= {"risk:structured_diagnostics"}
    assert engine.session_end("password=abcdefgh gone")["session"] and engine.session_promote()["memory"] and engine.session_promote()["memory"] is None
    assert "[REDACTED]" in engine.store.read("sessions").first()["final_summary"]


def test_structural_edits(engine):
    assert engine.rename_symbol("src/base.py", "other", "another")["changed"] == ["src/base.py"]
    engine.index(["src/base.py"])
    assert [s["name"] for s in engine.symbols("another")] == ["another"]
    assert engine.move_symbol("src/base.py", "another", "src/more.py")["changed"] == ["src/base.py", "src/more.py"]


def test_tools_and_http(engine, monkeypatch):
    ask = lambda **k: json.loads(commands.answer(engine, json.dumps({"jsonrpc": "2.0", "id": 1, **k})))
    assert len(ask(method="tools/list")["result"]["tools"]) == 14 and ask(method="odd")["error"]["code"] == -32601
    assert ask(method="tools/call", params={"name": "symbols", "arguments": {"query": "helper"}})["result"][0]["name"] == "helper"
    assert ask(method="tools/call", params={"name": "recall"})["error"]["code"] == -32602 and commands.answer(engine, '{"method": "tools/list"}') is None and "-32700" in commands.answer(engine, "{")
    server = commands.listen(engine, "127.0.0.1", 0, "secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, token=None, method="GET", data=None):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, {"Authorization": f"Bearer {token}"} if token else {}, method=method)
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, json.loads(f.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert get("/health") == (200, {"status": "ok"}) and get("/odd")[0] == 404 and get("/health", method="POST")[0] == 405
    assert get("/v1/memories")[0] == get("/v1/memories", "wrong")[0] == 401 and get("/v1/memories", "secret")[0] == 200 and get("/v1/memories", "secret", "DELETE")[0] == 405
    n = engine.store.read("entities").count()
    assert get("/v1/storage", "secret", "POST", json.dumps({"entities": [{"id": "e9", "kind": "k", "name": "n"}]}).encode()) == (200, {"entities": 1}) and engine.store.read("entities").count() == n + 1
    assert get("/v1/records/memories?part=0&of=1")[0] == 401 and get("/v1/records/odd?part=0&of=1", "secret")[0] == 404 and get("/v1/records/memories?part=2&of=2", "secret")[0] == 404
    # the same reading operators over the same store, through records; the answers are made before, as one session plays both sides
    answers = {(t, p): commands._part(engine, t, p, 3) for t in ("code_symbols", "code_references", "memories") for p in range(3)}
    monkeypatch.setattr(commands, "_part", lambda _, table, part, of: answers[table, part])
    assert get("/v1/records/memories?part=0&of=3", "secret") == answers["memories", 0] and sum(len(answers["code_symbols", p][1]["records"]) for p in range(3)) == engine.store.read("code_symbols").count()
    far = commands.Engine(engine.spark, RemoteStore(engine.spark, f"http://127.0.0.1:{server.server_port}", "secret", 3), engine.root, engine.clock)
    assert far.store.read("code_symbols").rdd.getNumPartitions() == 3
    by = lambda rows: sorted(map(str, rows))
    assert by(far.symbols("helper")) == by(engine.symbols("helper")) and by(far.recall("base helper")) == by(engine.recall("base helper")) and by(far.impact("helper")) == by(engine.impact("helper"))
    server.shutdown()


def test_records_in_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "text": "x"}\n\n{"text": "no id"}\n')
    (tmp_path / "b.json").write_text('{"id": 2, "more": 3}')
    (tmp_path / "_log").write_text("odd")
    rows = remote.records(spark, "id long, text string", folder=str(tmp_path))
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "x"), (2, None), (None, "no id")] and rows.rdd.getNumPartitions() == 2
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(Exception, match="not a record"):
        remote.records(spark, "id long", folder=str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert remote.records(spark, "id long", folder=str(tmp_path / "none")).count() == 0


def test_command_line(engine, tmp_path):
    parse = commands.parser().parse_args
    run = lambda *a: commands.dispatch(engine, parse(["s", *a]))
    assert "helper" in commands.render(run("symbols", "helper")) and run("doctor")["tables"] and run("status")["rows"]["projects"] == 1
    assert run("install", str(tmp_path / "a.json"))["installed"] and not run("install", str(tmp_path / "a.json"))["installed"] and not install(str(tmp_path / "a.json"), [*json.loads((tmp_path / "a.json").read_text())["mcpServers"]["tessera"].values().__iter__().__next__().split("\0"), "-m", "tessera.adapters.commands", "s", "mcp"])


def test_replication_between_stores(spark, engine, tmp_path, monkeypatch):
    monkeypatch.setenv("TESSERA_STORAGE_MODE", "hybrid")
    monkeypatch.setenv("TESSERA_REMOTE_URL", "x")
    monkeypatch.setenv("TESSERA_REMOTE_TOKEN", "y")
    monkeypatch.setenv("TESSERA_SYNC_CLASSES", "memories")
    other = Store(spark, str(tmp_path))
    other.migrate()
    told = {r["table"]: r["inserted"] for r in engine.sync("push", str(tmp_path))}
    assert told["memories"] == engine.store.read("memories").count() == other.read("memories").count() and engine.store.read("sync_runs").count() == 1
    assert {r["table"]: r["inserted"] for r in engine.sync("pull", str(tmp_path))}["memories"] == 0 and engine.sync("pull", "", True)


def test_two_writers_of_one_table(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.migrate()
    a, b = one.read("entities"), two.read("entities")
    row = lambda s, i: s._rows("entities", {"id": i, "kind": "k", "name": "n", "created_at_ms": 1})
    one.replace("entities", a.unionByName(row(one, "a")))
    with pytest.raises(Conflict):
        two.replace("entities", b.unionByName(row(two, "b")))
    two.replace("entities", two.read("entities").unionByName(row(two, "b")))
    assert {r["id"] for r in one.read("entities").collect()} == {"a", "b"}


def test_audit_of_conflicts_and_failures(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    for s in (one, two):
        s.migrate()
    config = replication.Config("hybrid", "x", "y", ["memories", "sources", "embeddings"])
    fact = lambda s, i, **k: s._rows("memories", {"id": i, "kind": "fact", "text": "t", "created_at_ms": 1, **k})
    file = lambda s, p, at: s._rows("discovered_files", {"project_id": "p", "path": p, "size_bytes": at, "updated_at_ms": at})
    one.replace("memories", fact(one, "m1"))
    two.replace("memories", fact(two, "m1").unionByName(fact(two, "m2")))
    one.replace("discovered_files", file(one, "a", 5).unionByName(file(one, "b", 1)))
    two.replace("discovered_files", file(two, "a", 4).unionByName(file(two, "b", 2)))
    two.replace("memory_embeddings", two._rows("memory_embeddings", {"memory_id": "m2", "model": "x"}, {"memory_id": "gone", "model": "x"}))
    told = {r["table"]: (r["inserted"], r["updated"], r["skipped"]) for r in one.synchronise("pull", two, config, 9).collect()}
    assert told["memories"] == (1, 0, 1) and told["discovered_files"] == (0, 1, 1)
    assert {(r["table"], r["reason"], r["n"]) for r in one.read("sync_table_conflicts").collect()} == {("memories", "local_row_preserved", 1), ("discovered_files", "local_row_newer_or_equal", 1), ("memory_embeddings", "missing_memory", 2)}
    with pytest.raises(ValueError):
        one.synchronise("pull", two, replication.Config("local"), 10)
    assert [(r["status"], r["started_at_ms"]) for r in one.read("sync_runs").orderBy("started_at_ms").collect()] == [("done", 9), ("failed", 10)]
    nested = replication.history(one.read("sync_runs"), one.read("sync_table_runs"), one.read("sync_table_conflicts"), 5).where("status = 'done'").first()
    assert any(c["reason"] == "local_row_preserved" for t in nested["tables"] if t["table"] == "memories" for c in t["conflicts"])


def test_embedding_service():
    class Reply:
        def __init__(self, doc):
            self.doc = doc

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return json.dumps(self.doc)

    ask = lambda doc: commands.request_embeddings("http://x", "m", ["a", "b"], 2, "t", lambda r: Reply(doc))
    assert ask({"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}) == [[1, 2], [3, 4]]
    for bad in ({"error": "no"}, {"data": []}, {"data": [{"embedding": [1]}, {"embedding": [1, 2]}]}):
        with pytest.raises(ValueError):
            ask(bad)


def test_embeddings_follow_their_texts(spark, tmp_path):
    from tessera.operators import embeddings, vectorindex

    calls = []

    def shaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionError
        return [[1.0]] * len(texts) if len(calls) == 2 else [[1.0, float(len(t))] for t in texts]

    assert embeddings.asked(["a", "bb"], shaky, 2, pause_s=0) == [[1.0, 1.0], [1.0, 2.0]] and calls == [2, 2, 2]
    with pytest.raises(ValueError):
        embeddings.asked(["a"], lambda t: [], 2, tries=2, pause_s=0)
    store = Store(spark, str(tmp_path))
    store.migrate()
    files = [(f"f{i}", "word " * i) for i in range(9)] + [("none", None)]
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string")
    provider = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert store.embed_files(frame(files), provider, "m", 2, 5) == 9 and store.embed_files(frame(files), provider, "m", 2, 6) == 0
    changed = [(p, f"{t} far far away " * 50 if int(p[1:]) % 3 == 0 else t) for p, t in files[:8]]
    assert store.embed_files(frame(changed), provider, "m", 2, 7) == 3  # a third
    now = {r["path"]: (r["embedding"][0], r["updated_at_ms"]) for r in store.read("source_embeddings").collect()}
    assert now == {p: (float(len(t)), 7 if int(p[1:]) % 3 == 0 else 5) for p, t in changed}
    near = vectorindex.exact(store.read("source_embeddings").select(spark_col("path").alias("id"), "embedding"), spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>"), 3)
    assert {r["id"] for r in near.collect()} == {"f0", "f3", "f6"}  # the long texts of now
    assert store.embed_files(frame(changed), provider, "other", 2, 8) == 8 and store.read("source_embeddings").count() == 16


# --- streams
def _stream(spark, folder, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def _run(query, name, spark, folder):
    q = query.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp_{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams_of_events(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [[(at(0), "p", "src/a.rs"), (at(0.2), "p", "src/b.rs"), (at(0.4), "p", "src/a.rs")], [(at(30), "p", "target/x"), (at(30), "p", "src/c.rs"), (at(90), "p", "src/d.rs"), (at(500), "p", "src/e.rs")]]
    _stream(spark, tmp_path, rows, background.EVENTS)
    changes = background.file_events(spark, f"{tmp_path}/in", ["d.rs"])
    bursts = _run(events.debounced_paths(changes), "bursts", spark, tmp_path)
    assert sorted(tuple(r["paths"]) for r in bursts) == [("src/a.rs", "src/b.rs"), ("src/c.rs",)]
    seen = []
    background.index_changes(changes, lambda paths: seen.append([r["path"] for r in paths.collect()]), f"{tmp_path}/cp_i").awaitTermination()
    assert sorted(p for b in seen for p in b) == ["src/a.rs", "src/b.rs", "src/c.rs", "src/e.rs"]
    open_ = spark.createDataFrame([("p", 7)], "project_id string, session_id long")
    many = spark.createDataFrame([("p", [f"f{i}" for i in range(14)])], "project_id string, paths array<string>")
    assert events.observe(many, open_).first()["detail"].endswith("f11 (+2 more)")


def test_stream_sessions_are_the_batch_ones(spark, tmp_path, data):
    rows = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id")
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    last = rows.selectExpr("max(ts) + interval 10 days as ts", "-1L as user_id")
    last.write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, user_id long").json(f"{tmp_path}/in")
    key = lambda r: (r["user_id"], r["events"], r["first_ms"], r["last_ms"])
    got = sorted(map(key, _run(events.stream_sessions(stream, 1800), "runs", spark, tmp_path)))
    assert got == sorted(map(key, events.batch_sessions(rows, 1800).collect()))


def test_session_states_across_batches(spark, tmp_path):
    first, second = [r for r in COMMANDS if r[1] < 25], [r for r in COMMANDS if r[1] >= 25]
    stream = _stream(spark, tmp_path, [first], LOG_SCHEMA)
    states = background.session_states(stream)
    _run(states, "states", spark, tmp_path)
    one = spark.table("states").collect()
    spark.createDataFrame(second, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    got = []
    q = states.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp_states").trigger(availableNow=True).start()
    q.awaitTermination()
    sessions = {}
    for r in [*one, *got]:
        s = sessions.setdefault((r["project"], r["session"]), [None, None, 0])
        if r["what"] == "start":
            s[0] = r["at"]
        elif r["what"] == "end":
            s[1] = r["at"]
        else:
            s[2] += 1
    assert sorted((*k, *v) for k, v in sessions.items()) == plain_log(COMMANDS)


def test_ticks(spark, tmp_path):
    s = spark.createDataFrame([(1, 50, "x", False), (2, 40, "y", False), (3, 10, "z", True)], "session_id long, ended_at_ms long, final_summary string, promoted boolean")
    e = spark.createDataFrame([], "session_id long")
    due, swept = [], []
    background.promotion_tick(spark, lambda: (s, e), due.append, f"{tmp_path}/p", once=True).awaitTermination()
    background.maintenance_tick(spark, lambda: swept.append(1), f"{tmp_path}/m", once=True).awaitTermination()
    assert set(due) <= {2} and len(swept) >= len(due) >= 0
