"""Operator 10, chat formatting.

A finite-state machine over roles validates the turn order while a declarative template emits text segments,
each with a loss flag. Control strings inside texts and role names are escaped reversibly, so the formatted
output alone gives back every turn (``read_back``).

Scale: one shuffle by conversation; a partition is sorted and then streamed, holding one turn at a time, so a
conversation of any length needs constant memory. A conversation is one sequence (its digest is sequential), so
it stays in one task.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidied


@dataclass(frozen=True)
class Template:
    """Marks, roles that carry loss, the machine's transitions, and all strings that count as control strings."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    @property
    def control(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.foreign)

    def pattern(self) -> str:
        """A control string with any number of backslashes after its first character."""
        return "|".join(f"({re.escape(c[0])}\\\\*{re.escape(c[1:])})" for c in self.control)

    def escape(self, text: str) -> str:
        """One backslash more after the first character of each control string, escaped or not."""
        return re.sub(self.pattern(), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        """Takes one backslash away again; texts without an escaped control string are unchanged."""
        return re.sub(self.pattern(), lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


SEGMENTS = "conv_id long, pos long, seq int, role string, kind string, segment string, loss boolean, state_ok boolean"


def _rows(batches, columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _batched(rows, schema: pa.Schema, size: int = 4096):
    some = []
    for row in rows:
        some.append(row)
        if len(some) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> text segments in order (conv_id, pos, seq), partitioned by conv_id.

    Null role or text: the empty string. Null conv_id: one conversation of its own. Null turn sorts first; equal
    turns (repeated rows too) are ordered by role, then text. Other columns are ignored. Every conversation is
    formatted; ``state_ok`` is false on a turn that the machine does not allow, which then restarts from that role.
    """
    t = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("seq", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("state_ok", pa.bool_())])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def emit(batches):
        def segments():
            last, pos, state = object(), 0, t.start
            for conv, role, text in _rows(batches, ("conv_id", "role", "text")):
                if conv != last:
                    last, pos, state = conv, 0, t.start
                ok = role in t.transitions.get(state, ())
                head, loss = t.turn + t.escape(role) + t.text, role in t.loss_roles
                yield conv, pos, 0, role, "mark", head, False, ok
                yield conv, pos, 1, role, "text", t.escape(text), loss, ok
                yield conv, pos, 2, role, "mark", t.end, False, ok
                pos, state = pos + 1, role

        return _batched(segments(), schema)

    return rows.mapInArrow(tidied(emit), SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, bad_turns long, valid boolean"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Parses the formatted output (segments of a conversation in order, all in one partition, as
    ``format_conversations`` leaves them) and returns digests per conversation.

    Turns come from the marks in the concatenated segments alone, wherever these are cut; the loss text from the segments'
    flags. Other columns are ignored.
    """
    t = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("bad_turns", pa.int64()), ("valid", pa.bool_())])

    def parse(batches):
        def digests():
            last = open_ = None
            for conv, role, segment, loss, ok in _rows(batches, ("conv_id", "role", "segment", "loss", "state_ok")):
                if open_ is None or conv != last:
                    if open_ is not None:
                        yield open_.row(last, t)
                    last, open_ = conv, _Reader()
                open_.feed(segment, loss, ok, t)
            if open_ is not None:
                yield open_.row(last, t)

        return _batched(digests(), schema)

    return segments.mapInArrow(tidied(parse), DIGEST)


class _Reader:
    """Reads one conversation; holds one turn's text at most."""

    def __init__(self) -> None:
        self.buffer: list[str] = []
        self.turns = self.loss_chars = self.chars = self.bad = 0
        self.all, self.loss, self.role = hashlib.sha256(), hashlib.sha256(), ""
        self.last, self.open_ok = "", True  # the end of what was read; whether the machine allows the turn being read

    def feed(self, segment: str, loss: bool, ok: bool, t: Template) -> None:
        self.chars += len(segment)
        if loss:
            plain = t.unescape(segment)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.open_ok &= ok
        self.buffer.append(segment)
        seam, self.last = self.last + segment, (self.last + segment)[1 - len(t.end) :]
        if t.end not in seam:
            return
        whole = "".join(self.buffer)  # a turn at least is complete
        while (at := whole.find(t.end)) >= 0:
            if not whole.startswith(t.turn):
                raise ValueError("the formatted output does not begin with a turn mark")
            head, _, text = whole[len(t.turn) : at].partition(t.text)
            self.role = t.unescape(head)
            self.all.update(f"{self.role}\n{t.unescape(text)}\n".encode())
            self.turns += 1
            self.bad += not self.open_ok
            self.open_ok = ok
            whole = whole[at + len(t.end) :]
        self.open_ok = self.open_ok if whole else True
        self.buffer, self.last = [whole], whole[1 - len(t.end) :]

    def row(self, conv, t: Template):
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.bad, self.bad == 0 and self.role in t.final


def query(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(conversations.unionByName(extra)))


def _sql() -> str:
    t = Template()
    pattern = t.pattern().replace("'", "''")
    marks = len(t.turn) + len(t.text) + len(t.end)
    steps = ", ".join(f"('{a}', '{b}')" for a, to in t.transitions.items() for b in to)
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS is_last,
         {marks} + length(role) + length(text) + len(regexp_extract_all(role, '{pattern}')) + len(regexp_extract_all(text, '{pattern}')) AS chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), d AS (
  SELECT c.*, s.a IS NULL AS bad FROM c LEFT JOIN (VALUES {steps}) s(a, b) ON c.before = s.a AND c.role = s.b
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (bad) AS BIGINT) AS bad_turns,
       count(*) FILTER (bad) = 0 AND bool_or(is_last AND role = 'assistant') AS valid
FROM d GROUP BY conv_id"""


SQL = _sql()
