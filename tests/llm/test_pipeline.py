"""The pipeline against plain versions of its stages, each judged on its own input."""

import re

import corpus_pipeline
from tessera.llm import mixing, secrets
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_jaccard import plain as plain_join


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns
        now = {r["doc_id"]: r for r in docs.collect()}
        assert len(now) == docs.count()
        if name == "language_id":
            assert all(now[k] == rows[k] for k in now) and len(now) >= 0.97 * sum(bool(re.search(r"[^\W\d_]", r["text"] or "")) for r in rows.values())
            assert not any(re.search(r"[^\W\d_]", rows[k]["text"] or "") is None for k in now)
        elif name == "jaccard_join":
            root = plain_join([(k, r["text"]) for k, r in rows.items()], 5, 80, 100)
            assert set(now) == {k for k, (_, c) in root.items() if c == k}
        elif name == "decontamination":
            gone = set(rows) - set(now)
            assert gone >= {k for k, r in rows.items() if any(t in r["text"] for _, t in items)}
            assert {d for _, d in plain_leaks([(k, rows[k]["text"]) for k in gone], items)} == gone
        elif name == "secret_scan":
            assert set(now) == set(rows)
            for k, r in now.items():
                assert r["n_chars"] == (len(r["text"]) if r["text"] != rows[k]["text"] else rows[k]["n_chars"])
                values = {v for *_, v in secrets.find(rows[k]["text"])}
                assert ("[SECRET]" in r["text"]) == (r["text"] != rows[k]["text"]) and (values or r["text"] == rows[k]["text"] or secrets.candidates(rows[k]["text"], []))
        rows = now
    got = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    size = {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    goal = {s: t for s, _, t in mixing.targets(list(size.items()))}
    assert all(abs(r["target"] - goal[r["source"]]) < 1e-6 for r in got)


def test_mask(spark):
    rows = [(i, f"key token = \"{'ab12' * 8}\" end", "en", f"s{i}", 0) for i in range(4)] + [(9, f"x token={'cd34' * 8}, y {'cd34' * 8} z", "en", "s1", 0), (10, None, "en", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS row")
    got = {r["doc_id"]: r for r in secrets.mask(d).collect()}
    assert got[9]["text"] == "x token=[SECRET], y [SECRET] z" and got[9]["n_chars"] == len(got[9]["text"])
    assert all(got[i]["text"] == rows[i][1] and got[i]["n_chars"] == 0 for i in range(4)) and got[10]["text"] is None


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert 0 < out.count() <= spark.read.parquet(f"{data}/documents.parquet").count() and "doc_id" in out.columns


def test_stages_keep_columns_of_any_name(spark, data):
    """Each stage returns the columns it was given, untouched, whatever they are called."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60")
    names = ["score", "lang_pred", "lang_spans", "a.b", "text_", "Row", "kept", "full", "empty", "cuts", "SIZE", "tick`"]
    odd = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, data)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name
    assert len(corpus_pipeline.STAGES[-1][1](spark, odd, data).collect()) == odd.count()


def test_stages_use_no_workers_beside_those_of_dataframes(spark, data, monkeypatch):
    """Functions over an RDD run in Python workers of their own, which stay alive on every executor beside the others."""
    from pyspark import RDD, SparkContext

    def refused(*_, **__):
        raise AssertionError("an RDD runs Python")

    for name in ("map", "mapPartitions", "mapPartitionsWithIndex", "treeReduce", "collect"):
        monkeypatch.setattr(RDD, name, refused)
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count(), name


def test_tree_sums_over_many_partitions(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.llm.common import packed, tree_sum

    one = np.zeros(9, np.int64)
    one[[2, 7]] = 3, -1
    rows = spark.range(0, 300, numPartitions=70).select(F.lit(packed(one)).alias("blob"))
    assert tree_sum(rows, 9).tolist() == (300 * one).tolist()
    assert tree_sum(rows.limit(0), 9).tolist() == [0] * 9
