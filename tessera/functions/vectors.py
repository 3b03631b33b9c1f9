"""Expressions over vectors and hashes; no Python on the way."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col, tokens

LOW = 0xFFFFFFFF
# The 64-bit FNV-1a offset and prime (2^40 + 435).
FNV_OFFSET, FNV_LOW = 0xCBF29CE484222325 - 2**64, 435


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products over the shorter length, in double."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalise(v: Column | str) -> Column:
    """Unit length; a zero vector is unchanged."""
    n = norm(v)
    return F.when(n == 0, col(v)).otherwise(F.transform(col(v), lambda x: x / n))


def pad(v: Column | str, width: int) -> Column:
    return F.slice(F.concat(col(v), F.array_repeat(F.lit(0.0), width)), 1, width)


def fnv1a(text: Column | str) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long: the product is taken in halves so that nothing overflows."""
    hexed = F.hex(F.encode(col(text), "utf-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest((F.length(hexed) / 2).cast("int"), F.lit(1))), lambda i: F.conv(F.substring(hexed, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    bytes_ = F.when(F.length(hexed) == 0, F.array().cast("array<bigint>")).otherwise(bytes_)

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        lo, hi = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32)
        t = lo * FNV_LOW
        high = (hi * FNV_LOW + F.shiftrightunsigned(t, 32) + F.shiftleft(lo, 8)).bitwiseAND(F.lit(LOW))
        return F.shiftleft(high, 32).bitwiseOR(t.bitwiseAND(F.lit(LOW)))

    return F.aggregate(bytes_, F.lit(FNV_OFFSET), step)


def content_key(text: Column | str) -> Column:
    """FNV-1a as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fnv1a(text))), 16, "0")


def embed_terms(rows: DataFrame, id_col: str, text_col: str, width: int = 1536) -> DataFrame:
    """Sparse hashed bag of words, (id, index, weight): every token adds 1 + bits 32..39 / 255, signed by bit 63,
    at its hash modulo the width; rows are unit vectors. Terms are hashed once each, so the fold runs per distinct word."""
    terms = rows.select(F.col(id_col), F.explode(tokens(text_col)).alias("term"))
    counted = terms.groupBy(id_col, "term").agg(F.count("*").alias("n"))
    h = F.col("h")
    hashed = counted.select("term").distinct().withColumn("h", fnv1a("term")).select(
        "term",
        # unsigned remainder of a signed long
        F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(width)) * 2 + h.bitwiseAND(F.lit(1)), F.lit(width)).alias("index"),
        (F.when(h < 0, -1.0).otherwise(1.0) * (1 + F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(255)) / 255.0)).alias("w"),
    )
    summed = counted.join(hashed, "term").groupBy(id_col, "index").agg(F.sum(F.col("w") * F.col("n")).alias("v")).where("v <> 0")
    length = summed.groupBy(id_col).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return summed.join(length, id_col).select(id_col, "index", (F.col("v") / F.col("len")).alias("weight"))


def to_blob(values: list[float], width: int = 1536) -> bytes:
    """A vector as stored: little-endian floats, filled up with zeros or cut to a width."""
    return struct.pack(f"<{width}f", *(list(values) + [0.0] * width)[:width])


def from_blob(blob: bytes) -> list[float]:
    """A stored vector; one whose length is no whole number of floats is an error."""
    if len(blob) % 4:
        raise ValueError("a vector has four bytes a number")
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))
