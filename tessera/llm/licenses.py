"""Operator 12, license scans by diagonal voting.

Every run of k words of a text is hashed and joined to the places where templates have it. A hit at word i of the text and
word t of a template votes for the diagonal i - t, on which the template would begin. Neighbouring diagonals of one
template, as words put in or left out make them, are merged; what has votes enough is compared with the words of the text:
a phrase must stand there word by word, a longer notice must share most of its words in order.

Scale: one scan emits the runs of k words in slices of bounded size, Spark explodes and joins them with the templates, a
table of checked size that is broadcast (beyond the bound it is an ordinary join), and only hits and a row a text are
saved. Votes are counted before their shuffle, by text, template and diagonal. The second scan sends on the texts that have
something to verify (chosen by a bitmap of fixed size), once. No key is shared by texts, so copies and common lines make
no task larger; a single text's hits meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, bloom, bloom_has, discard, portions, save, shingles, table, tidied, word_hashes, word_spans

K = 3
SLICE = 4096
LEAST_VOTES, LEAST_SHARE = 0.5, 0.8
MOST_BROADCAST = 200_000
#: The phrases that must stand word by word, with their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Notices of well-known licenses, in words; a text holds one if most of its words stand there in order.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
#: Bytes outside words, of lower-cased texts.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def grams_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all runs of k words of the texts joined, edges of the texts in words, where runs of one text begin)."""
    words, edges, *_ = word_hashes([t.lower() for t in texts], BETWEEN)  # of bytes: A-Z only
    runs = shingles(words, k)
    inside = np.ones(len(runs), bool)
    for e in edges[1:-1]:
        inside[max(0, e - k + 1) : e] = False
    return runs, edges, inside


def _templates(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int) -> tuple[DataFrame, bool]:
    """(gram, template, at) of all runs of k words of the templates; whether it may be broadcast."""
    rows = []
    for n, (_, text, _) in enumerate(templates):
        runs, _, _ = grams_of([text.encode()], k)
        rows += [(int(g), n, at) for at, g in enumerate(runs.view(np.int64).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, at int"), len(rows) <= MOST_BROADCAST


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _slices(docs: DataFrame, k: int) -> DataFrame:
    """(row, doc_id, n_words, first, grams): for each text one row without grams, then its runs of k words in slices."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches):
        for b in batches:
            texts, rows, ids = as_bytes(b.column("text")), b.column("row").to_pylist(), b.column("doc_id").to_pylist()
            for lo, hi in portions([len(t) for t in texts]):
                runs, edges, _ = grams_of(texts[lo:hi], k)
                runs = runs.view(np.int64)
                out = []
                for t, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), lo):
                    out.append((rows[t], ids[t], z - a, 0, None))
                    out += [(rows[t], None, None, s - a, runs[s : min(s + SLICE, z - k + 1)]) for s in range(a, z - k + 1, SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "doc_id", "n_words", "first", "grams"])

    return docs.mapInArrow(tidied(run), "row long, doc_id long, n_words long, first long, grams array<long>")


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of one large number."""
    where: dict[bytes, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _merged(votes: DataFrame) -> DataFrame:
    """(row, template, low, high, votes): diagonals low..high of one template, merged if they are neighbours. ``votes`` has
    (row, template, diagonal, n, words). Steps of up to a quarter of the template are neighbours, and a merged band is at
    most as wide as half of it, so that repeats of one template stay apart."""
    step, width = F.greatest(F.lit(0), F.floor(F.col("words") / 4)), F.floor(F.col("words") / 2) + 1
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > step, F.lit(True))
    chained = votes.withColumn("chain", F.sum(new.cast("int")).over(by))
    first = F.min("diagonal").over(Window.partitionBy("row", "template", "chain"))
    band = F.floor((F.col("diagonal") - first) / width)
    out = chained.withColumn("band", band).groupBy("row", "template", "words", "chain", "band")
    return out.agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("n").alias("votes"))


def scan(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, k: int = K, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) of every row of ``docs``; a span is (start, end, label, exact, score): words start..end of
    the text hold a template of that label. ``templates`` are (label, words, exact); an exact one must stand word by word
    and has the score 1, another must share ``LEAST_SHARE`` of its words in order, its score. Spans are ordered.

    Null, empty and wordless texts: no words, no spans. Null or repeated ids: each row stands for itself. Templates of
    fewer than k words are refused. An empty table gives no rows. Other columns are ignored. Overlapping spans all count.
    The table is read twice and must give its rows in one order, as a stored table does.
    """
    templates = [(a, b, True) for a, b in PHRASES] + [(a, b, False) for a, b in NOTICES] if templates is None else templates
    told = [(label, [w for w in _words(text.encode(), 0, None)], exact) for label, text, exact in templates]
    if any(len(w) < k for _, w, _ in told):
        raise ValueError(f"a template has fewer than {k} words")
    spark = docs.sparkSession
    places, small = _templates(spark, templates, k)
    texts = _texts(docs, text_col)
    grams = _slices(texts, k).select("row", "doc_id", "n_words", "first", F.posexplode_outer("grams").alias("step", "gram"))
    hits = grams.join(F.broadcast(places) if small else places, "gram", "left").where("gram is null or template is not null")
    hits = save(hits.select("row", "doc_id", "n_words", "template", (F.col("first") + F.col("step") - F.col("at")).alias("diagonal")), "hits")
    base = hits.where("template is null").select("row", "doc_id", "n_words")
    size = F.element_at(F.array(*(F.lit(len(w)) for _, w, _ in told)), F.col("template") + 1)
    votes = hits.where("template is not null").groupBy("row", "template", "diagonal").agg(F.count("*").alias("n")).withColumn("words", size)
    likely = _merged(votes).where(F.col("votes") >= LEAST_VOTES * (F.col("words") - k + 1))
    spans = save(likely.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("bands")), "bands")
    held = spark.sparkContext.broadcast(bloom(spans, "row"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("exact", pa.bool_()), ("score", pa.float64())]))

    def wanted(batches):
        for b in batches:
            yield b.filter(pa.array(bloom_has(held.value, np.array(b.column("row"), np.int64))))

    def verify(batches):
        for b in batches:
            out = []
            for text, bands in zip(as_bytes(b.column("text")), b.column("bands").to_pylist(), strict=True):
                out.append([dict(zip(("start", "end", "label", "exact", "score"), x, strict=True)) for x in _verified(text, bands, told)])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, kind)], ["row", "spans"])

    span = "array<struct<start:long,end:long,label:string,exact:boolean,score:double>>"
    some = texts.select("row", "text").mapInArrow(tidied(wanted), "row long, text string").join(spans, "row")
    found = save(some.mapInArrow(tidied(verify), f"row long, spans {span}"), "licenses")
    out = base.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(span)).alias("spans"))
    discard(spans)
    return out


def _words(text: bytes, lo: int, hi: int | None) -> list[bytes]:
    data, _, start, end = word_spans([text.lower()], BETWEEN)
    return [data[a:b].tobytes() for a, b in zip(start[lo:hi], end[lo:hi], strict=True)]


def _verified(text: bytes, bands: list[dict], told: list[tuple[str, list[bytes], bool]]) -> list[tuple]:
    """(start, end, label, exact, score) of the templates that the words of a text hold on or near the given diagonals."""
    data, _, start, end = word_spans([text.lower()], BETWEEN)
    n = len(start)
    out = set()
    for band in bands:
        label, words, exact = told[band["template"]]
        m = len(words)
        for d in range(max(0, band["low"]), band["high"] + 1) if exact else ():
            if d + m <= n and [data[start[k] : end[k]].tobytes() for k in range(d, d + m)] == words:
                out.add((d, d + m, label, True, 1.0))
        if not exact:
            a, z = max(0, band["low"]), min(n, band["high"] + m)
            here = [data[start[k] : end[k]].tobytes() for k in range(a, z)]
            if (share := lcs(words, here) / m) >= LEAST_SHARE:
                out.add((a, z, label, False, share))
    return sorted(out)


def query(spark, sf_dir: str) -> DataFrame:
    """The spans of every document as counts, places and labels; score is that of the best span."""
    found = scan(table(spark, sf_dir, "documents"))
    exact = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(exact, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
