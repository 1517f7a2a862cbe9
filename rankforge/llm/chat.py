"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  The
formatter knows nothing of its markup: it renders the prefixes of a
conversation one turn at a time, takes what each output adds to the one before
as that turn's span, and finds the text inside a span by rendering the turn once
more with a probe character as its text.  The text spans of the assistant's
turns make up the loss mask.  A template whose output for more turns does not
begin with its output for fewer rewrites history; it is detected, the spans
that reach into the rewritten part are dropped, and the row says so.

The template here opens a turn with "### role:" and a new line and closes it
with "</turn>" and a new line; a backslash goes before every backslash, "###"
and "</turn>" in a text (and before every colon and new line in a role), which
makes the output readable back.

Conversations are brought together by a sort on (conv_id, turn, role, text) and
streamed, so a task holds one conversation and one batch at a time.

Defined cases: null text and null role count as empty; null turns come first;
rows with equal turn are ordered by role and text, and repeated rows are turns
of their own; rows with a null conv_id form one conversation; texts of any length
are rendered whole, and a conversation is one task's work; extra columns are not
carried; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OPEN, CLOSE, ESCAPE = "### ", "</turn>\n", "\\"
LEARNED_ROLE = "assistant"

_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")
_STEP = re.compile(r"\\(?:\\|###|</turn>|:|\n)|</turn>\n|:\n")
#: Stands for a text while its place is looked for; no template gives it a meaning.
_PROBE = "\x01"


def escape(text: str, strings: re.Pattern[str] = _IN_TEXT) -> str:
    return strings.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class TurnTemplate:
    """The template of this module; remembers the output for the turns it saw last.

    A call whose turns continue the remembered ones escapes only the turns after
    them, so rendering all prefixes of a conversation escapes every turn once.
    """

    def __init__(self) -> None:
        self._turns: list[Turn] = []
        self._output = ""

    def __call__(self, turns: list[Turn]) -> str:
        known = len(self._turns) if turns[: len(self._turns)] == self._turns else 0
        output = (self._output if known else "") + "".join(f"{OPEN}{escape(role, _IN_ROLE)}:\n{escape(text)}{CLOSE}" for role, text in turns[known:])
        if len(turns) != known + 1 or turns[-1][1] != _PROBE:
            self._turns[known:], self._output = turns[known:], output
        return output


def turn_template(turns: list[Turn]) -> str:
    return TurnTemplate()(turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of turn_template."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn opens at {at}")
        begin = at + len(OPEN)
        colon = next(m for m in _STEP.finditer(formatted, begin) if m[0] == ":\n")
        close = next(m for m in _STEP.finditer(formatted, colon.end()) if m[0] == CLOSE)
        turns.append((unescape(formatted[begin : colon.start()]), unescape(formatted[colon.end() : close.start()])))
        at = close.end()
    return turns


class Formatted(NamedTuple):
    output: str
    #: Per turn the (begin, end) of its text in the output, None where history was rewritten.
    spans: list[tuple[int, int] | None]
    #: Index of the first turn whose rendering changed what stood before it.
    rewritten_at: int | None


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def format_turns(turns: list[Turn], template: Template | None = None) -> Formatted:
    """Render all prefixes; without a template, by a new `TurnTemplate`."""
    template = template or TurnTemplate()
    output, spans, rewritten_at = template([]), [], None
    for k, (role, _) in enumerate(turns):
        probe = template([*turns[:k], (role, _PROBE)])
        longer = template(turns[: k + 1])
        stable = len(output)
        if not longer.startswith(output):
            rewritten_at = k if rewritten_at is None else rewritten_at
            stable = _common(output, longer)
            spans = [s if s and s[1] <= stable else None for s in spans]
        before = probe.find(_PROBE, stable)
        after = len(probe) - before - 1
        # both renderings begin with the `stable` characters that the output keeps, or the probe's history differs
        alike = probe.startswith(output if stable == len(output) else output[:stable]) and longer[stable:before] == probe[stable:before]
        if before < 0 or not alike or longer[len(longer) - after :] != probe[before + 1 :]:
            spans.append(None)
        else:
            spans.append((before, len(longer) - after))
        output = longer
    return Formatted(output, spans, rewritten_at)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Runs of equal ids; the batches are sorted."""
    now, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if turns and conv != now:
                yield now, turns
                turns = []
            now = conv
            turns.append((role, text))
    if turns:
        yield now, turns


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, spans (turn, role, begin, end; null where lost) and rewritten_at."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])
        rows, held = [], 0
        types = [pa.string(), pa.list_(span), pa.int64()]

        def out() -> pa.RecordBatch:
            ids = pa.array([r[0] for r in rows], pa.string() if kind == "string" else pa.int64())
            return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types))], names=["conv_id", "formatted", "spans", "rewritten_at"])

        for conv, turns in _conversations(batches):
            made = format_turns(turns, template)
            spans = [{"turn": k, "role": turns[k][0], "begin": s and s[0], "end": s and s[1]} for k, s in enumerate(made.spans)]
            rows.append((conv, made.output, spans, made.rewritten_at))
            held += len(made.output)
            if held > 1 << 23:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    blank = F.lit("")
    turns = conversations.select(
        F.col("conv_id") if kind in ("string", "bigint") else F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = "string" if kind == "string" else "bigint"
    return arrow_map(ordered, render, f"conv_id {kind}, formatted string, spans array<struct<turn:bigint,role:string,begin:bigint,end:bigint>>, rewritten_at bigint")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted text and its loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for output, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = output.as_py()
                turns, said, loss, chars = read_back(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, own in turns:
                    said.update(f"{role}\n{own}\n".encode())
                for span in spans.as_py():
                    if span["role"] == LEARNED_ROLE and span["begin"] is not None:
                        learned = unescape(text[span["begin"] : span["end"]])
                        chars += len(learned)
                        loss.update(learned.encode())
                rows.append((len(turns), said.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return arrow_map(
        formatted.select("conv_id", "formatted", "spans"),
        read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


#: A conversation that quotes the template's own control strings.
QUOTING = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(QUOTING).alias("text")
    )
    return digest(format_conversations(rows.unionByName(extra)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'), chr(10), '\' || chr(10))) + 2
           + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
