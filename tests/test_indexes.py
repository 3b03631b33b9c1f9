"""Containment joins, stored indexes and context packs of many tasks, against plain versions."""

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions import text as X
from tessera.operators import containment, memory, recall, sessions, tasks, textindex, vectorindex
from tessera.plans import context as plans
from tessera.sources import model as M
from tessera.sources import scratch


# --- containment
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc@ +é/", max_size=9), max_size=8), st.lists(st.text("abc@ +é/", max_size=5), max_size=8))
def test_containing_is_contains(spark, texts, needles):
    t = spark.createDataFrame([*enumerate(texts), (99, None)], "key long, text string")
    n = spark.createDataFrame([*((x,) for x in needles), (None,)], "needle string")
    got = sorted(tuple(r) for r in containment.containing(t, n).collect())
    assert got == sorted((i, x) for i, text in enumerate(texts) for x in set(needles) if x and x in text)


def test_edits_are_found_inside_details(spark):
    paths = ["a b/c d.py", "@scope/x+y.ts", "src/a.rs", "rc/a.rs", "x"]
    events = [("wrote a b/c d.py today", 5), ("('@scope/x+y.ts')", 6), ("lib/src/a.rs.bak", 7), ("lib/src/a.rs.bak", 9), ("src/a.rs", 1), (None, 8)]
    got = sessions.edits_after(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(events, "detail string, at long"), 2)
    assert {tuple(r) for r in got.collect()} == {("a b/c d.py", 5), ("@scope/x+y.ts", 6), ("src/a.rs", 9), ("rc/a.rs", 9), ("x", 6)}


# --- text index
def texts(n, seed):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = ["the"] * rng.randrange(4) + ["and"] * rng.randrange(2) + rng.choices(rare, k=rng.randrange(12)) + rng.choices(rare[:8], k=rng.randrange(6))
        rng.shuffle(words)
        out.append((i, " ".join(words)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "the " * 3000)]


QUERIES = [(1, "the w1 w2"), (2, "the and"), (3, "w250"), (4, "nowhere"), (5, "w0 w1 w2 w3 w4 w5 the the"), (6, None), (7, "")]


@pytest.mark.parametrize("pool,block", [(3, 1024), (20, 7)])
def test_text_index_is_bm25(spark, tmp_path, monkeypatch, pool, block):
    monkeypatch.setattr(textindex, "BLOCK", block)
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    old, new = texts(700, 1), [(i + (40 if i > 650 else 0), t if i % 3 else f"{t} w7") for i, t in texts(700, 1) if i % 11]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    key = lambda df: sorted((r["query_id"], r["fts_rank"], r["id"], r["bm25"]) for r in df.collect())
    textindex.build(frame(old)).write(str(tmp_path / "one"))
    one = textindex.read(spark, str(tmp_path / "one"))
    assert key(textindex.search(one, q, pool)) == key(recall.bm25(frame(old), q, pool))
    due, gone = textindex.changes(one, frame(new))
    was, now = dict(old), dict(new)
    assert {r["id"] for r in due.collect()} == {i for i, t in new if i not in was or (was[i] or "") != (t or "")}
    assert {r["id"] for r in gone.collect()} == {i for i, t in old if i not in now or (now[i] or "") != (t or "")}
    textindex.update(one, frame(new)).write(str(tmp_path / "two"))
    two = textindex.read(spark, str(tmp_path / "two"))
    assert key(textindex.search(two, q, pool)) == key(recall.bm25(frame(new), q, pool))
    empty = textindex.build(frame([]))
    assert textindex.search(empty, q, pool).count() == 0 and key(textindex.search(textindex.update(empty, frame(old)), q, pool)) == key(textindex.search(one, q, pool))


def test_a_search_opens_few_blocks_of_common_terms(spark, monkeypatch):
    """Documents that only common terms bring do not become candidates."""
    monkeypatch.setattr(textindex, "BLOCK", 16)
    rows = [(i, "the " * (1 + i % 3) + f"filler{i}" + (" needle" * (1 + i % 5) if i % 50 == 0 else "")) for i in range(2000)]
    kept = []
    monkeypatch.setattr(textindex, "keep", lambda df, name: kept.append((name, scratch.keep(df, name))) or kept[-1][1])
    docs, q = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(1, "the needle")], "query_id long, query string")
    got = textindex.search(textindex.build(docs), q, 10).collect()
    assert len(got) == 10 and all(r["id"] % 50 == 0 for r in got)
    assert dict(kept)["brought"].count() == 40


def test_postings_are_moved_once(spark, monkeypatch):
    """Blocks are made, and written, where the packed postings of a term meet; a common term has many blocks."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(textindex, "BLOCK", 16)
    docs = spark.createDataFrame([(i, f"the the w{i % 7} x{i}") for i in range(300)], "id long, text string")
    blocks = textindex.build(docs).blocks
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = blocks.collect()
    got = sorted((r["term"], p["id"], p["tf"], p["length"]) for r in rows for p in r["postings"])
    assert got == sorted((r["term"], r["id"], r["tf"], r["length"]) for r in recall.postings(docs).collect())
    assert all(r["n"] == len(r["postings"]) and r["most"] == max(p["tf"] for p in r["postings"]) and r["least"] == 4 for r in rows)
    assert {r["parts"] for r in rows if r["term"] == "the"} == {19} and len({(r["term"], r["block"]) for r in rows}) == len(rows)
    placed = spark.createDataFrame([(r["term"], r["block"], r["parts"], r["bucket"], p["id"]) for r in rows for p in r["postings"]], "term string, block long, parts long, bucket int, id long")
    assert not placed.where((textindex.block_of(F.col("id"), F.col("parts")) != F.col("block")) | (textindex.bucket_of(F.col("term")) != F.col("bucket"))).count()


# --- vector index
def vectors(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.4) for x in centres[i % 6]]) for i in range(n)]


def plain_top(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v] if any(v) else list(v)
    out = {}
    for q, w in queries:
        if ok(w):
            scored = [(-(round(sum(a * b for a, b in zip(unit(w), unit(v), strict=True)), 6) + 0.0), i) for i, v in rows if ok(v) and len(v) == len(w)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: x for q, x in out.items() if x}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["vector_rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("block,group", [(2048, 256), (17, 3)])
def test_vector_search(spark, tmp_path, monkeypatch, block, group):
    monkeypatch.setattr(vectorindex, "BLOCK", block)
    monkeypatch.setattr(vectorindex, "GROUP", group)
    rows = vectors(300, 8, 2) + [(1000 + i, vectors(6, 8, 2)[3][1]) for i in range(40)]  # one vector many times
    rows += [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, [0.0] * 8), (2004, [1.0, 2.0]), (2005, [])]
    queries = [*rows[:40:3], (105, [float("inf")] * 8), (107, [3.0, 4.0]), (109, [0.0] * 8), (111, None)]
    d, q = spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    want = plain_top(rows, queries, 5)
    assert found(vectorindex.exact(d, q, 5)) == want
    vectorindex.build(d, cells=9).write(str(tmp_path / "v"))
    index = vectorindex.read(spark, str(tmp_path / "v"))
    assert found(vectorindex.search(index, q, 5, probes=9)) == want  # all cells
    few = found(vectorindex.search(index, q, 5, probes=3))
    assert sum(len(set(few.get(k, [])) & set(v)) for k, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_vector_index_of_nothing(spark):
    none, q = spark.createDataFrame([], "id string, embedding array<float>"), spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<float>")
    assert vectorindex.exact(none, q, 3).count() == 0 and vectorindex.search(vectorindex.build(none), q, 3).count() == 0
    some = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0])], "id string, embedding array<float>")  # no direction to fit cells on
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<float>")
    assert [r["id"] for r in vectorindex.search(vectorindex.build(some), q, 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        vectorindex.build(some, cells=0)


# --- packs
def test_one_task_has_the_pack_that_it_has_among_many(spark, data):
    known = plans._known(spark, data)
    some = M.tasks(spark, data).where("task_id in (3, 8, 21)")
    key = lambda df: sorted((r["pack_id"], r["section"], r["rank"], r["id"], r["score"], r["tokens"], r["evicted"]) for r in df.collect())
    together = key(tasks.Packs(some, known).packs(3000))
    alone = key(tasks.Packs(some.where("task_id = 8"), known).packs(3000))
    assert [x for x in together if x[0] == 8] == alone and len({x[1] for x in together}) == 11


def test_packs_of_awkward_tasks(spark, data):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "zz"), (5, "promo ring for user supplier_3")]
    packs = tasks.Packs(spark.createDataFrame(rows, "task_id long, task string"), plans._known(spark, data), files=2, symbols=1)
    assert {r["task_id"] for r in packs.symbols.collect()} == {5} and packs.symbols.count() == 1
    assert {r["task_id"]: r["n"] for r in packs.files.groupBy("task_id").count().withColumnRenamed("count", "n").collect()}[5] in (2, 3)
    assert {r["pack_id"] for r in packs.packs(2000).collect()} == {1, 2, 3, 4, 5}  # steps and changes are in every pack
    packs.close()


def test_symbols_of_a_task_are_all_that_fit(spark, data):
    """The join on stretches of four letters loses no symbol that scores."""
    from pyspark.sql import functions as F

    known = M.symbols(spark, data).withColumn("language", F.lit("rust")).withColumn("parameters", F.lit(1))
    asked = tasks.prepared(spark.createDataFrame([(1, "promo rings"), (2, "red bolt small"), (3, "src"), (4, "e")], "task_id long, task string"))
    got = {(r["task_id"], r["symbol_id"], r["recall"]) for r in tasks.symbols_of(asked, known, 10_000).collect()}
    score = X.symbol_score(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), F.col("q_terms"), F.col("task"))
    want = {(r["task_id"], r["symbol_id"], r["recall"]) for r in known.crossJoin(asked).withColumn("recall", score).where("recall > 0").collect()}
    assert got == want and len(want) > 100


def test_bodies_of_selected_symbols_only(spark, data):
    packs = tasks.Packs(M.tasks(spark, data).where("task_id < 6"), plans._known(spark, data))
    names = {(r["task_id"], r["name"]) for r in packs.symbols.collect()}
    for r in packs.risks.where("kind in ('deep_nesting', 'cyclomatic_complexity')").collect():
        for item in re.sub(r" \(\+\d+ more\)$", "", r["summary"]).split(": ", 1)[1].split(", "):
            assert (r["task_id"], item.split(" ")[0]) in names


def test_conflicts_of_some_facts_are_those_of_all(spark, data):
    facts = M.active(M.memories(spark, data))
    some = facts.where("id % 40 = 1").select("id")
    ids = {r["id"] for r in some.collect()}
    key = lambda df: sorted((r["newer"], r["older"], r["signal"], r["shared"]) for r in df.collect())
    all_ = key(memory.contradictions(facts, plans.CORPUS_SIGNALS))
    assert key(memory.contradictions(facts, plans.CORPUS_SIGNALS, some=some)) == [x for x in all_ if x[0] in ids or x[1] in ids]


# --- commit logs and references
@pytest.mark.parametrize("width", [2, 3, 4096])
def test_lines_follow_their_header(spark, width):
    from pyspark.sql import functions as F

    from tessera.sources import workspace as W

    rng = random.Random(width)
    rows = sorted((n, rng.choice("h....")) for n in rng.sample(range(-50, 400), 150))
    got = W.last_before(spark.createDataFrame(rows, "line long, text string"), F.col("text") == "h", width).collect()
    last, want = None, {}
    for n, t in rows:
        last = n if t == "h" else last
        want[n] = last
    assert {r["line"]: r["last"] for r in got} == want and len(got) == len(rows)


def plain_references(files, symbols):
    """Token by token: own symbols hide imported ones, these hide the rest; calls of members keep all functions."""
    out = set()
    word = r"(?<![\w$])%s(?![\w$])"
    for path, text in files:
        lines = text.split("\n")
        imports = "\n".join(x for x in lines if re.match(r"\s*(use|import|from) ", x) or "require(" in x)
        for n, line in enumerate(lines, 1):
            if re.match(r"\s*(//|/\*|\*|$)", line):
                continue
            for name in set(re.findall(r"[^\W\d][\w$]*|\$[\w$]*", line)):
                hits = [s for s in symbols if s[1] == name and not (s[0] == path and s[3] == n)]
                own = [s for s in hits if s[0] == path]
                known = [s for s in hits if re.search(word % re.escape(s[0].rsplit("/", 1)[-1].split(".")[0]), imports)]
                member = re.search(r"(\.|::|->)\s*" + word % re.escape(name) + r"\s*\(", line)
                for s in hits:
                    if s in (own or known or hits) or (member and s[2] == "function"):
                        out.add((path, n, s[0], name, s[2]))
    return out


def test_references_of_a_name_that_many_files_declare(spark):
    from tessera.operators import code

    rng = random.Random(9)
    files, symbols = [], []
    for i in range(30):
        path = f"src/m{i}.py"
        body = [f"import m{rng.randrange(30)}" if rng.random() < 0.6 else "# nothing", f"from m{rng.randrange(30)} import get" if rng.random() < 0.4 else ""]
        if i % 3 == 0:
            symbols.append((path, "get", "function", len(body) + 1))
            body.append("def get(x):")
        if i % 7 == 0:
            symbols.append((path, "Cart", "class", len(body) + 1))
            body.append("class Cart:")
        body += rng.sample(["    get(1)", "    x.get(2)", "    Cart()", "    // get", "    y = other(get, Cart)", "    Cart.get(3)", f"    own{i}(1)"], 4)
        symbols.append((path, f"own{i}", "function", 99))
        files.append((path, "\n".join(body)))
    f = spark.createDataFrame([(p, "python", t) for p, t in files], "path string, language string, text string")
    s = spark.createDataFrame(symbols, "path string, name string, kind string, line_start long")
    got = [(r["path"], r["line_start"], r["target_path"], r["target_name"], r["target_kind"]) for r in code.references(f, s).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_references(files, symbols) and len(got) > 200


def test_vectors_go_to_python_in_batches_of_bounded_bytes(spark, tmp_path):
    """Rows of a block and a group of queries are large, so a limit of rows alone does not bound a worker."""
    name, was = vectorindex.BATCH_BYTES, spark.conf.get(vectorindex.BATCH_BYTES, None)
    rows = vectors(1500, 8, 3)
    docs, q = spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(rows[::2], "query_id long, query_vector array<double>")
    try:
        for search in (lambda: vectorindex.exact(docs, q, 3), lambda: vectorindex.search(vectorindex.build(docs, cells=4), q, 3, probes=4)):
            spark.conf.set(name, str(1 << 30))
            found = search()
            assert int(spark.conf.get(name)) <= 1 << 22
            assert {(r["query_id"], r["id"]) for r in found.where("vector_rank = 1").collect()} >= {(i, i) for i in range(0, 1500, 500)}
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)
