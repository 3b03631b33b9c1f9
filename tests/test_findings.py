"""What a reviewer found: results that a limit cut, and steps whose work outgrew their input."""

import hashlib

from pyspark.sql import functions as F

from tessera.operators import graph


def test_an_impact_report_counts_all_tests(spark):
    symbols = spark.createDataFrame([("src/abc.rs", "f", 1, 5)], "path string, name string, line_start long, line_end long")
    references = spark.createDataFrame([], "path string, line_start long, target_path string, target_name string")
    known = spark.createDataFrame([(f"tests/abc_{i}_test.go",) for i in range(40)], "path string")
    assert graph.impact_report(symbols, references, symbols, known).first()["tests"] == 40


def test_lines_inside_ranges_of_all_lengths(spark):
    ranges = [("a", lo, lo + n) for lo in (-70, 0, 1, 63, 64, 500) for n in (0, 1, 63, 64, 700)] + [("b", 5, None), ("b", 9, 7), ("c", None, 3)]
    lines = [("a", n, i) for n in range(-80, 1300, 7) for i in (0, 0, 1)] + [("b", n, 0) for n in range(12)] + [("c", 2, 0), ("c", None, 0), (None, 1, 0)]
    want = sorted(x for x in lines if any(x[0] == p and x[1] is not None and lo is not None and lo <= x[1] <= (lo if hi is None else hi) for p, lo, hi in ranges))
    got = graph.inside(spark.createDataFrame(lines, "path string, line_start long, i int"), spark.createDataFrame(ranges, "path string, line_start long, line_end long"))
    assert sorted(map(tuple, got.select("path", "line_start", "i").collect())) == want


def test_lines_do_not_meet_all_ranges_of_their_file(spark):
    n = 40_000  # of one file: a product of lines and ranges takes minutes
    ranges = spark.range(n).select(F.lit("a").alias("path"), (F.col("id") * 2).alias("line_start"), (F.col("id") * 2).alias("line_end"))
    lines = spark.range(3 * n).select(F.lit("a").alias("path"), F.col("id").alias("line_start"))
    assert graph.inside(lines, ranges).count() == n
    plan = graph.inside(lines, ranges)._jdf.queryExecution().optimizedPlan().toString()
    met = [p for p in plan.split("\n") if "Join" in p and "lo" in p and "hi" in p]
    assert met and all("cell" in p for p in met)


def test_symbols_that_differ_in_their_lines_are_ranked_once(spark, monkeypatch):
    from tessera.functions import text as X
    from tessera.operators import tasks

    rows = [(f"src/{p}.rs", f"{w}_order", "function", None if p == "c" else f"fn {w}_order()", 10 * i + k) for k, p in enumerate("abc") for w in ("load", "store") for i in range(30)]
    symbols = spark.createDataFrame(rows, "path string, name string, kind string, signature string, line_start long")
    asked = tasks.prepared(spark.createDataFrame([(1, "load order"), (2, "store c"), (3, "nothing here")], "task_id long, task string"))
    score = X.symbol_score(F.col("name"), F.col("path"), F.col("kind"), F.col("signature"), F.col("q_terms"), F.col("task"))
    every = asked.crossJoin(symbols).withColumn("recall", score).where("recall > 0").collect()
    want = [(t, *x[:5]) for t in (1, 2, 3) for x in sorted((-r["recall"], r["path"], r["line_start"], r["name"], r["signature"] or "") for r in every if r["task_id"] == t)[:8]]
    met, plain = [], tasks._meet
    monkeypatch.setattr(tasks, "_meet", lambda a, b, texts: met.append(texts.count()) or plain(a, b, texts))
    got = tasks.symbols_of(asked, symbols, 8).collect()
    assert sorted((r["task_id"], -r["recall"], r["path"], r["line_start"], r["name"], r["signature"] or "") for r in got) == sorted(want)
    assert met == [6]


def test_conflicts_of_classes_are_those_of_all_pairs(spark, monkeypatch):
    from tessera.operators import memory

    monkeypatch.setattr(memory, "SIDE_BLOCK", 2)
    signals = [("aaa", "bbb", "one"), ("ccc", "ddd", "two")]
    sides = ["aaa", "bbb", "ccc", "ddd", "aaa bbb", "aaa ccc", "bbb ddd", "ccc ddd", "aaa bbb ccc ddd"]
    texts = [f"{s} {w}" for s in sides for w in ("", "red", "red blue", "blue größe red", "größe blue", "other words here")]
    facts = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts + texts[:20])], "id long, created_at_ms long, text string")
    terms = {i: set(t.split()) for i, t in enumerate(texts + texts[:20])}
    want = set()
    for x, xs in terms.items():
        for y, ys in terms.items():
            first = [name for a, b, name in signals if x != y and (a in xs and b in ys)]
            other = [name for a, b, name in signals if x != y and (a in ys and b in xs)]
            if (first or other) and len(xs & ys) >= 2:
                newer, older = (x, y) if (-(x % 3), x) < (-(y % 3), y) else (y, x)
                want.add((newer, older, min(first + other), " ".join(sorted(xs & ys, key=str.encode))))
    assert set(map(tuple, memory.contradictions(facts, signals).collect())) == want and want
    plan = memory.class_conflicts(memory.fact_classes(facts, signals))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("FlatMapCoGroupsInArrow")  # pairs are not shuffled by name afterwards


def test_packed_vectors_are_not_broadcast(spark):
    from tessera.operators import vectorindex

    v = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vectorindex.build(v, 4)
    for found in (vectorindex.exact(v, q, 3), vectorindex.search(index, q, 3, 4)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.split("MapInArrow")[1].split("Join")[0].endswith("SortMerge")  # the join of blocks with queries
        assert found.count() == 45


def test_pairs_in_conflict_are_not_moved_again(spark):
    from tessera.operators import memory

    signals = [("aaa", "bbb", "one"), ("ccc", "ddd", "two")]
    texts = ["aaa bbb red blue", "aaa bbb red blue", "bbb ddd red blue", "ccc red blue", "aaa ddd red green blue"]
    facts = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, created_at_ms long, text string")
    pairs = memory.contradictions(facts, signals)
    above = pairs._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "Join" not in above and "Aggregate" not in above
    rows = sorted(map(tuple, pairs.collect()))
    assert [r[:3] for r in rows] == [(0, 1, "one"), (0, 2, "one"), (0, 4, "one"), (1, 2, "one"), (1, 4, "one"), (2, 3, "two"), (2, 4, "one"), (3, 4, "two")]
    digests = sorted(map(tuple, memory.contradictions(facts, signals, digest=True).collect()))
    assert digests == [(*r[:3], hashlib.md5(r[3].encode()).hexdigest()) for r in rows]
    again = facts.unionByName(spark.createDataFrame([(1, 0, "aaa bbb red blue")], facts.schema))  # an id that two facts have
    assert sorted(map(tuple, memory.contradictions(again, signals).collect())) == rows


def test_conflicts_of_tasks_carry_no_texts(spark):
    from tessera.operators import context, memory, tasks
    from tessera.operators import evidence as E

    signals = [("aaa", "bbb", "one")]
    texts = ["aaa red blue", "bbb red blue mixred", "bbb Red blue, red", "aaa red blue größe", "red only"]
    facts = spark.createDataFrame([(i, "k", t, 0) for i, t in enumerate(texts)], "id long, kind string, text string, created_at_ms long")
    asked = tasks.prepared(spark.createDataFrame([(1, "red mix red"), (2, "größe unknown"), (3, "re")], "task_id long, task string"))
    found = spark.createDataFrame([(1, 0), (1, 1), (2, 3), (3, 2)], "task_id long, id long")
    got = tasks.conflicts_of(asked, found, facts, signals)
    assert not {c for c in got.columns if c.endswith("_text")}
    pairs = memory.contradictions(facts, signals)
    told = lambda side: facts.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"), context.memory_tokens().alias(f"{side}_tokens"))
    rows = pairs.join(told("newer"), "newer").join(told("older"), "older").join(found, F.col("id").isin(F.col("newer"), F.col("older"))).drop("id").distinct().join(asked, "task_id")
    match = lambda side: E.match(F.col(f"{side}_text"), F.col("terms"))
    want = rows.select("task_id", "newer", "older", "newer_tokens", "older_tokens", match("newer"), match("older"), F.size(F.split("shared", " ")))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got.select("task_id", "newer_id", "older_id", "newer_tokens", "older_tokens", "newer_match", "older_match", "n_shared")) == key(want) and want.count() == 7


def test_recall_moves_no_postings(spark, monkeypatch):
    from tessera.functions import text as X
    from tessera.operators import recall

    monkeypatch.setattr(recall, "BLOCK_TOKENS", 8)
    monkeypatch.setattr(recall, "GROUP", 1)
    texts = ["red blue, red", None, "", "Größe RED-ish red_blue", "blue blue green", "red blue red", "-- !! ", " green größe ", "of in", *["common word"] * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    queries = spark.createDataFrame([("a", "red blue red"), ("b", "größe"), ("c", "in of"), ("d", "common"), ("e", None), ("f", "absent")], "query_id string, query string")
    assert [r["all"].split() for r in docs.orderBy("id").select(X.joined_tokens("text").alias("all")).collect()] == [r["t"] for r in docs.orderBy("id").select(X.tokens("text").alias("t")).collect()]
    # the plain rule: a row for each term that a query and a document share
    p, q = recall.postings(docs), queries.select("query_id", F.explode(F.array_distinct(X.query_terms("query"))).alias("term"))
    n, average = len(texts), sum(r["length"] for r in recall.tokenised(docs).collect()) / len(texts)
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(recall.LEAST_IDF))
    w = idf * F.col("tf") * (recall.K1 + 1) / (F.col("tf") + recall.K1 * (1 - recall.B + recall.B * F.col("length") / average))
    plain = q.join(p, "term").join(df, "term").groupBy("query_id", "id").agg(F.round(-F.sum(w), 6).alias("bm25")).collect()
    want = [(a, i, s, k + 1) for a in "abcdef" for k, (s, i) in enumerate(sorted((r["bm25"], r["id"]) for r in plain if r["query_id"] == a)[:4])]
    found = recall.bm25(docs, queries, 4)
    assert sorted(map(tuple, found.select("query_id", "id", "bm25", "fts_rank").collect())) == sorted(want) and len(want) == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "term" not in plan.split("MapInArrow")[0]  # above the blocks only each query's best


def test_shared_terms_are_counted_not_written(spark):
    from tessera.functions import text as X
    from tessera.operators import memory

    signals = [("aaa", "bbb", "one")]
    texts = ["aaa red größergrößer blue", "bbb red größergrößer", "bbb blue größergrößer red-and-blue", "aaa red-and-blue blue"]
    facts = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, created_at_ms long, text string")
    words = F.split("shared", " ")
    want = memory.contradictions(facts, signals).select("newer", "older", "signal", F.size(words), F.aggregate(words, F.lit(0), lambda n, w: n + X.tokens_of(w)))
    got = memory.contradictions(facts, signals, numbers=True)
    assert got.columns == ["newer", "older", "signal", "n_shared", "shared_tokens"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 3
    again = facts.unionByName(facts.where("id = 1"))
    assert sorted(map(tuple, memory.contradictions(again, signals, numbers=True).select(got.columns).collect())) == sorted(map(tuple, got.collect()))


def test_a_refreshed_index_has_a_small_plan(spark, data):
    from tessera.operators import indexing
    from tessera.sources import model as M

    sources = M.source_files(spark, data)
    symbols, references = indexing.full(sources)
    changed = sources.select("path").where("path like '%1.rs'")
    for found in indexing.refresh(sources, changed, symbols, references):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") < 40


def test_a_large_file_of_records_is_read_in_parts(tmp_path, monkeypatch):
    import gzip
    import json

    from pyspark.sql import types as T

    from tessera.sources import remote

    rows = [{"id": i, "text": "größe" * (i % 7)} for i in range(200)]
    text = "\n".join(json.dumps(r, ensure_ascii=False) + ("\n" if r["id"] % 9 == 0 else "") for r in rows)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(text + "\n")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json.gz").write_bytes(gzip.compress(text.encode()))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    for stretch in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(remote, "STRETCH", stretch)
        reader = remote.RecordReader(schema, {"folder": str(tmp_path)})
        parts = reader.partitions()
        got = sorted((r["id"], r["text"]) for p in parts for b in reader.read(p) for r in b.to_pylist())
        assert got == sorted((r["id"], r["text"]) for r in rows for _ in range(3))
        assert len(parts) == 1 + 2 * max(1, -(-len(text.encode()) // stretch)) + (len(text.encode()) % stretch == 0)


def test_term_tokens_splits_a_text_once(spark, data):
    from tessera.plans import recall as plans

    plan = plans.term_tokens(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_commit_tasks_move_no_lines(spark, data):
    from tessera.plans import source
    from tessera.sources import model, workspace

    lines = model.commit_lines(spark, data)
    assert sorted(workspace.subjects(lines).collect()) == sorted(workspace.commits(lines).select("hash", "subject").collect())
    assert "Exchange" not in source.commit_tasks(spark, data)._jdf.queryExecution().executedPlan().toString()


def test_records_older_than_the_newest_thousand_are_found(spark):
    from tessera.operators import neighbourhood as N

    terms = spark.createDataFrame([(1, ["old", "src"]), (2, ["file_11", "src"]), (3, ["nothing"])], "task_id long, terms array<string>")
    kinds = "id string, kind string, name string, locator string, created_at_ms long"
    entities = spark.createDataFrame([(f"n{i}", "old" if i == 2 else "kind", f"name{i}", f"src/file_{i}.rs" if i % 2 else None, i * 7 % 1300) for i in range(1300)], kinds)
    sources = spark.createDataFrame([(f"s{i}", "old" if i == 3 else "file", f"src/file_{i}.rs", i) for i in range(1300)], "id string, kind string, locator string, created_at_ms long")
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i * i % 1300}", "in", i) for i in range(1300)], "id string, from_id string, to_id string, kind string, created_at_ms long")
    show = lambda newest: sorted(map(str, N.records(entities, sources, edges, terms, 4, newest).collect()))
    every = show(None)
    assert every == show(10**6) and any("source s3 " in r for r in every)


def test_blocks_of_documents_are_buffered_a_few_at_a_time(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from tessera.operators import recall
    from tessera.sources.scratch import folder

    monkeypatch.setattr(recall, "BLOCK_TOKENS", 8)
    docs = spark.range(0, 200, 1, 1).select("id", F.concat_ws(" ", F.lit("one two three four"), F.concat(F.lit("word"), F.col("id"))).alias("text"))
    asked = spark.createDataFrame([(1, "word7"), (2, "three")], "query_id long, query string")
    at = lambda: set(glob.glob(folder(spark).replace("file:", "") + "/blocks-*/*.parquet"))
    before = at()
    got = recall.bm25(docs, asked, 5).collect()
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, at() - before) for i in range(f.metadata.num_row_groups)]
    assert sum(groups) > 50 and max(groups) <= 4
    assert [r["id"] for r in got if r["query_id"] == 1] == [7] and sum(r["query_id"] == 2 for r in got) == 5
