"""Worked cases of single operators, and eviction against a greedy loop."""

import datetime
import random

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import code, pack
from tessera.streaming import events as S


def test_short_queries_still_search(spark):
    d = spark.createDataFrame([("io",), ("go vm",), ("north star of",), ("?!",), (None,)], "q string")
    assert [r[0] for r in d.select(X.query_terms("q")).collect()] == [["io"], ["go", "vm"], ["north", "star"], [], []]


def test_words_of_scripts_with_vowel_signs(spark):
    d = spark.createDataFrame([("हिन्दी भाषा, x-y_z",)], "t string")
    tokens, n = d.select(X.tokens("t"), X.token_count("t")).first()
    assert len(tokens) == n and "भाषा" in tokens and tokens[-1] == "x-y_z"


def test_symbols_rank_by_fit(spark):
    rows = [("load_parcel_order", "src/parcel.rs", "function", "fn load_parcel_order()"), ("ParcelLimit", "src/parcel.rs", "struct", "struct ParcelLimit"), ("MOST_WEIGHT", "src/other.rs", "constant", "const MOST")]
    d = spark.createDataFrame(rows, "name string, path string, kind string, signature string")
    q = F.lit("load parcel order")
    got = [r[0] for r in d.select(X.symbol_score(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), X.query_terms(q), q)).collect()]
    assert got[0] > got[1] > got[2]


def test_redaction_leaves_ports(spark):
    d = spark.createDataFrame([("ssh -p 2222 host",), ("mysql -pHunter2",)], "t string")
    assert [r[0] for r in d.select(X.redact("t")).collect()] == ["ssh -p 2222 host", "mysql -p[REDACTED]"]


def test_fnv(spark):
    def plain(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    words = ["", "a", "hello", "naïve", "日本"]
    d = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r[0] for r in d.select(V.content_key("t")).collect()] == [plain(w) for w in words]


def test_wildcards():
    import re

    assert re.match(X.wildcard_regex("src/*.r?"), "src/a/b.rs") and not re.match(X.wildcard_regex("src/*.rs"), "lib/a.rs")


def test_reference_kinds(spark):
    rows = [
        ("use crate::Shape;", "Shape", "struct", "import"), ("impl Area for Shape {", "Shape", "struct", "implementation"), ("class Child(Base):", "Base", "class", "inheritance"),
        ("let s: Shape = x;", "Shape", "struct", "type_reference"), ("return new Shape()", "Shape", "class", "instantiation"), ("x.run()", "run", "function", "method_call"), ("run (1)", "run", "function", "call"), ("run later", "run", "function", "reference"),
    ]
    d = spark.createDataFrame(rows, "line string, name string, kind string, want string")
    assert d.where(code.reference_kind("line", "name", "kind") != F.col("want")).count() == 0


def greedy(items, budget, fixed):
    sections = {}
    for section, rank, score, tokens in items:
        sections.setdefault(section, []).append((rank, score, tokens))
    for s in sections.values():
        s.sort()
    total, touched, gone = sum(i[3] for i in items) + fixed, set(), set()
    while total > budget:
        for floor in (3, 0):
            weak = [(s[-1][1] * 64 // max(1, s[-1][2]), k) for k, s in sections.items() if len(s) > floor]
            if weak:
                break
        else:
            break
        k = min(weak)[1]
        rank, _, tokens = sections[k].pop()
        total -= tokens - (0 if k in touched else 8)
        touched.add(k)
        gone.add((k, rank))
    return gone


def test_eviction_is_the_greedy_rule(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for p in range(150):
        items = [(s, r, rng.randrange(900), rng.randrange(9, 90)) for s in range(9) for r in range(1, rng.randrange(1, 9))]
        items = [(s, r, sorted((i[2] for i in items if i[0] == s), reverse=True)[r - 1], t) for s, r, _, t in items] if p % 2 else items
        want[p] = greedy(items, 900, 66)
        rows += [(p, *i) for i in items]
    got = {p: set() for p in want}
    for r in pack.evict(spark.createDataFrame(rows, "pack_id long, section int, rank int, score long, tokens long"), 900, 66).where("evicted").collect():
        got[r["pack_id"]].add((r["section"], r["rank"]))
    assert got == want


def test_some_sections_go_before_all_others(spark):
    items = [(1, -2, r, 0, 10) for r in (1, 2, 3)] + [(1, -1, r, 0, 20) for r in (1, 2)] + [(1, 4, r, 900 - r, 30) for r in range(1, 6)]
    d = spark.createDataFrame(items, "pack_id int, section int, rank int, score long, tokens long")
    changed = {(-2, r) for r in (1, 2, 3)}
    for budget, gone in ((500, set()), (215, {(-2, 3), (-2, 2)}), (190, changed | {(-1, 2)}), (160, changed | {(-1, 1), (-1, 2), (4, 5)})):
        got = {(r["section"], r["rank"]) for r in pack.evict(d, budget, 0).where("evicted").collect()}
        assert got == gone, budget


def test_stream_gives_the_batch_sessions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=m), u) for u in range(3) for m in (0, 5, 50, 55, 56, 200 + u)] + [(start + datetime.timedelta(days=9), 99)]
    d = spark.createDataFrame(rows, "ts timestamp, user_id long")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = S.stream_sessions(stream, 1800).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    out = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == sorted(tuple(r) for r in S.batch_sessions(d.where("user_id < 99"), 1800).collect())


def test_rename_and_replace(spark):
    import pytest

    from tessera.operators import edits

    files = spark.createDataFrame([("a.py", "python", "def run(x):\n    return x\n\ndef other():\n    return run(1)\n"), ("b.py", "python", "import a\nrunner = a.run(2)  # run\n"), ("c.py", "python", "run = 3\n")], "path string, language string, text string")
    symbols = code.declarations(files)
    got = {r["path"]: r["text"] for r in edits.rename(files, symbols, code.references(files, symbols).where("path <> 'c.py'"), "a.py", "run", "start").collect()}
    assert got == {"a.py": "def start(x):\n    return x\n\ndef other():\n    return start(1)\n", "b.py": "import a\nrunner = a.start(2)  # start\n"}
    with pytest.raises(edits.EditError):
        edits.rename(files, symbols, symbols, "a.py", "run", "other")
    text = "class A:\n    def f(self):\n        return 1\n"
    assert edits.replace_symbol(text, "python", "f", 2, 3, "def f(self):\n    return 2") == "class A:\n    def f(self):\n        return 2\n"
    with pytest.raises(edits.EditError):
        edits.replace_symbol(text, "python", "f", 2, 3, "def f(self:\n    return 2")


def test_workspace_scan(spark, tmp_path):
    from tessera.sources import workspace

    for name in ("src/a.rs", "b.log", "target/x.rs", "docs/r.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("fn a() {}\n")
    (tmp_path / ".gitignore").write_text("*.log\n")
    got = {(r["path"], r["language"]) for r in workspace.scan(spark, str(tmp_path)).collect()}
    assert got == {("src/a.rs", "rust"), ("docs/r.md", "markdown"), (".gitignore", None)}


def test_tools_answer_requests(spark, data):
    import json

    from tessera.adapters import tools

    assert tools.clamp("recall", None) == 10 and tools.clamp("recall", 900) == 50 and tools.clamp("recall", -1) == 1
    lines = [
        '{"jsonrpc":"2.0","id":1,"method":"tools/list"}', '{"jsonrpc":"2.0","method":"tools/list"}', "{broken", '{"id":2,"method":"tools/call","params":{"name":"symbols","arguments":{"query":"promo","limit":3}}}',
        '{"id":3,"method":"tools/call","params":{"name":"nothing"}}', '{"id":4,"method":"other"}', '{"id":5,"method":"tools/call","params":{"name":"recall","arguments":{"query":"the","limit":2}}}',
    ]
    got = [json.loads(x) for x in tools.respond(spark, data, lines)]
    assert [g["id"] for g in got] == [1, None, 2, 3, 4, 5]
    assert len(got[2]["result"]["rows"]) == 3 and "error" in got[3] and got[4]["error"]["code"] == -32601 and len(got[5]["result"]["rows"]) == 2


def test_diagnostic_rank_of_many_paths(spark):
    from tessera.operators import sessions

    paths = spark.range(20_000).selectExpr("concat('p', id) AS path")
    g = spark.range(100).selectExpr("id", "concat('p', id * 200) AS path", "'note' AS severity", "'m' AS message", "id AS created_at_ms")
    got = sessions.diagnostic_rank(g, "purchase", paths, limit=1000).collect()
    assert len(got) == 100 and all(r["score"] == 120 for r in got)
