"""A corpus pipeline of five stages, each one of the corpus operators; every stage reads what the one before wrote.

Stages (name, function): a function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. SQL cannot express them; tests hold them against plain versions.

All stages keep columns of any name, let rows with a null or repeated doc_id stand for themselves unless said otherwise,
and return no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, langid, mixing, secrets
from tessera.llm.common import bound_batches, column, discard, release, save, table, unused

LEAST_SHARE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language and those of which no language covers half: null, empty and letterless texts go.
    Languages are learned from all rows with one; if there is none, all rows go. Ties go to the language that sorts first."""
    bound_batches(spark)
    names = tuple(unused(n, docs) for n in ("lang_pred", "score", "lang_spans"))
    told = langid.identify(docs, langid.train(docs.where("lang is not null")), names=names)
    return told.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SHARE)).select([column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every group linked by a Jaccard likeness of 0.8 over five words. Documents without words,
    null texts too, all stay; of copies that share their doc_id one stays; a null doc_id counts as the smallest."""
    bound_batches(spark)
    return jaccard.representatives(docs, width=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item or its paraphrase. Null and empty texts stay, and all do where the
    benchmark has no text. Copies go together."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that few owners hold; widely copied examples stay. Every row is kept; null and empty texts are as
    they were; a null source is an owner of its own."""
    bound_batches(spark)
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix to target weights takes: a row for every row, null texts with none. A null
    source is one source, the last. Order and draws are seeded, ties broken by doc_id, size and place."""
    bound_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("language_id", keep_languages),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        discard(*before)  # of the texts the last copy is read only
        before = [docs]
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
