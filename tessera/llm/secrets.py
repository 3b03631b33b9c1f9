"""Operator 6, secret scans with corpus-wide ownership frequency.

Three shapes of secret are always reported. Beyond them, any long token of mixed letters and digits is a candidate;
candidates are hashed, and for every hash the distinct repositories and distinct owners that hold it are counted over
the whole corpus. A value that few owners hold, in few repositories, looks live and is added to the spans; one that is
copied widely is an example and is not. The base shapes get the same verdict as a label only. Where a table tells no owner
apart from the repository, as ``documents`` does with its ``source``, that column is both.

Scale: one scan of the texts leaves small rows (saved); frequencies are grouped after map-side distinct, so a value
in a third of all rows is a handful of rows per task; the live values are saved and meet the spans in an ordinary join of
two stored tables, whose hot side Spark may split. Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_text, column, save, tidied, unused

#: Fixed shapes, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The candidate shape that the frequency decides on.
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "live")


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the base shapes, ordered by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with a letter and at least four digits, outside the base spans."""
    taken: list[list[int]] = []  # base spans, in order, those that overlap joined
    for s, e, *_ in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, i = [], 0
    for m in LONG.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        v = m[0]
        if (i == len(taken) or taken[i][0] >= m.end()) and sum(map(str.isdigit, v)) >= 4 and any(map(str.isalpha, v)):
            out.append((m.start(), m.end(), 3, v))
    return out


SCAN = "row long, doc_id long, repository string, owner string, spans array<struct<start:long,end:long,kind:int,value:string,value_at:long>>"


def scan(docs: DataFrame, text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One small row a document: all base and candidate spans with the hash of each value (never the value)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string()), ("value_at", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = []
            for text in as_text(batch.column("text")):
                base = find(text)
                spans.append([{"start": s, "end": e, "kind": k, "value": hashlib.sha256(v.encode()).hexdigest()[:32], "value_at": e - len(v)} for s, e, k, v in base + candidates(text, base)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(spans, span)], ["row", "doc_id", "repository", "owner", "spans"])

    return rows.mapInArrow(tidied(run), SCAN)


def ownership(spans: DataFrame) -> DataFrame:
    """value -> distinct repositories and owners (a null one counts as one of its own), and occurrences."""
    seen = spans.groupBy("value", F.coalesce("repository", F.lit("\0")).alias("repository"), F.coalesce("owner", F.lit("\0")).alias("owner")).agg(F.count("*").alias("n"))
    return seen.groupBy("value").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"), F.sum("n").alias("occurrences"))


def live_values(spans: DataFrame, most_owners: int, most_repositories: int) -> DataFrame:
    """The values that few owners hold in few repositories."""
    return ownership(spans).where((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).select("value")


def _judged(docs: DataFrame, repo_col: str, owner_col: str, most_owners: int, most_repositories: int) -> tuple[DataFrame, DataFrame]:
    """(scanned rows, their spans and whether the value of each looks live)."""
    found = save(scan(docs, repo_col=repo_col, owner_col=owner_col), "secrets")
    flat = found.select("row", "repository", "owner", F.explode("spans").alias("s")).select("row", "repository", "owner", "s.start", "s.end", "s.kind", "s.value", "s.value_at")
    live = save(live_values(flat, most_owners, most_repositories), "live").withColumn("live", F.lit(True))
    return found, flat.join(live, "value", "left").withColumn("live", F.col("live").isNotNull())


def secret_scan(docs: DataFrame, repo_col: str = "source", owner_col: str = "source", most_owners: int = 2, most_repositories: int = 2) -> DataFrame:
    """One row a document: counts and digest of the base spans, all spans, and how many look live.

    Null text: no spans. Null or repeated doc_ids: each row stands for itself. An empty table gives no rows. Columns
    other than doc_id, text, repository and owner are ignored.
    """
    found, judged = _judged(docs, repo_col, owner_col, most_owners, most_repositories)
    kept = judged.where("kind < 3 or live")
    each = kept.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    label = F.array(*(F.lit(k) for k in KINDS))
    told = lambda x: F.concat_ws(":", F.element_at(label, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    out = found.select("row", "doc_id").join(each, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean>>")))
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter("all", lambda x: x["kind"] < 3), told), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("all", told), ",").alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def mask(docs: DataFrame, repo_col: str = "source", owner_col: str = "source", most_owners: int = 2, most_repositories: int = 2, sign: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` the values of spans that look live are replaced by a sign, and
    n_chars, if there is such a column, follows. Rows without any are unchanged: null and empty texts, null or repeated
    doc_ids. Spans that overlap are one. An empty table gives no rows. Columns of any name are kept. The texts are
    shuffled once."""
    _, judged = _judged(docs, repo_col, owner_col, most_owners, most_repositories)
    row, cuts, new = (unused(c, docs) for c in ("row", "cuts", "new"))
    found = judged.where("live").groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_set(F.struct("value_at", "end"))).alias(cuts))
    merged = F.aggregate(  # (text so far, end of the last cut)
        cuts,
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda a, c: F.when(c["value_at"] < a["at"], F.struct(a["text"].alias("text"), F.greatest(a["at"], c["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["text"], F.substring("text", (a["at"] + 1).cast("int"), (c["value_at"] - a["at"]).cast("int")), F.lit(sign)).alias("text"), c["end"].alias("at"))
        ),
        lambda a: F.concat(a["text"], F.substring("text", (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    out = docs.withColumn(row, F.monotonically_increasing_id()).join(found.hint("shuffle_hash"), row, "left")
    out = out.withColumn(new, F.when(F.col(cuts).isNull(), F.col("text")).otherwise(merged))
    kept = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return out.select([kept[c].alias(c) if c in kept else column(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
