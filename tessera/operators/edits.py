"""Structural edits over lines of text: a rename touches the declaration and the lines that refer to it, nothing else;
a replacement swaps one symbol's lines for new ones with the old indentation."""

from __future__ import annotations

import ast
import re
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import code

NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


class EditError(ValueError):
    """An edit that is refused, and why."""


def rename(files: DataFrame, symbols: DataFrame, references: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """(path, text) of the files that change. The target must be one symbol, and the new name free in its file."""
    if not NAME.fullmatch(new):
        raise EditError(f"not a name: {new}")
    targets = symbols.where((F.col("path") == path) & (F.col("name") == old)).select("path", "line_start").limit(2).collect()
    if len(targets) != 1:
        raise EditError("no such symbol" if not targets else "more than one such symbol")
    if symbols.where((F.col("path") == path) & (F.col("name") == new)).head(1):
        raise EditError(f"{new} is there already")
    at = references.where((F.col("target_path") == path) & (F.col("target_name") == old)).select("path", F.col("line_start").alias("line"))
    at = at.union(files.sparkSession.createDataFrame([(path, targets[0]["line_start"])], "path string, line long")).distinct().withColumn("hit", F.lit(True))
    rows = code.lines(files).join(at.select("path").distinct(), "path", "left_semi").join(at, ["path", "line"], "left")
    pattern = rf"(?<![\p{{L}}\p{{N}}_$])\Q{old}\E(?![\p{{L}}\p{{N}}_$])"
    text = F.when(F.col("hit"), F.regexp_replace("text", pattern, new.replace("$", r"\$"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


# Words that declare a symbol of a kind.
DECLARES = {"function": "fn def func fun function", "class": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface", "module": "mod", "protocol": "protocol", "record": "record", "object": "object"}


def replace_symbol(text: str, language: str, name: str, line_start: int, line_end: int, body: str, kind: str | None = None) -> str:
    """A file's text with the lines of a symbol replaced; the new text must declare the same name with a word of the same
    kind, where the old text did, and, in Python, parse."""
    lines = text.split("\n")
    if not 1 <= line_start <= line_end <= len(lines):
        raise EditError("lines outside the file")
    indent = re.match(r"\s*", lines[line_start - 1])[0]
    fresh = textwrap.indent(textwrap.dedent(body).strip("\n"), indent).split("\n")
    if not re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])", fresh[0] if not fresh[0].lstrip().startswith("@") else "\n".join(fresh)):
        raise EditError(f"the new text does not declare {name}")
    words = rf"\b({'|'.join(DECLARES.get(kind or '', '').split())})\s+{re.escape(name)}\b" if kind in DECLARES else None
    if words and re.search(words, "\n".join(lines[line_start - 1 : line_end])) and not re.search(words, "\n".join(fresh)):
        raise EditError(f"the new text declares no {kind} {name}")
    out = "\n".join([*lines[: line_start - 1], *fresh, *lines[line_end:]])
    if language == "python":
        try:
            ast.parse(out)
        except SyntaxError as e:
            raise EditError(f"the file would not parse: {e}") from e
    return out
