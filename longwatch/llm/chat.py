"""Chat formatting by incremental black-box rendering.

A template is a function of a list of turns. It is rendered over successive
prefixes of a conversation, and what a prefix adds to the one before is its
last turn's span. Where the output of a shorter prefix is not the start of a
longer one's, the template rewrites history, and the spans up to there do not
hold. Prefixes are whole unless a window is given: then they start anew every
few turns, with the last turn before as context, in time that grows with the
turns, which is right only for a template that looks no further back. That is
proved for each conversation: after 1, 2, 4, 8, ... turns, and at its end, the
whole prefix is rendered once and must be just the spans found so far. Where it
is not, all prefixes of that conversation are rendered whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwatch.llm.common import read

Turn = tuple[str, str]
#: Turns of a prefix for a template that renders each turn by itself.
WINDOW = 16
_HEAD, _END = "### ", "</turn>"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_SPAN = re.compile(r"### ((?:\\.|[^\\:])*): (.*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Puts a backslash before backslashes and the template's control strings."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(_END, "\\" + _END)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """Marks each turn by its role in front and an end mark behind."""
    return "".join(f"{_HEAD}{escape(role).replace(':', '\\:')}: {escape(text)}{_END}\n" for role, text in turns)


def read_turn(span: str) -> tuple[str, int, int] | None:
    """(role, start, end of the escaped text) of a span of turn_template, or None."""
    m = _SPAN.fullmatch(span)
    return (unescape(m[1]), m.start(2), m.end(2)) if m else None


class Spans:
    """Spans of one conversation's turns, one turn at a time."""

    def __init__(self, render: Callable[[list[Turn]], str], window: int | None):
        self.render, self.window = render, window
        self.turns: list[Turn] = []
        self.last = render([])

    def add(self, turn: Turn) -> tuple[str, int]:
        """(what the turn adds, characters of earlier output that it rewrites)."""
        if self.window is not None and len(self.turns) > self.window:
            self.turns = self.turns[-1:]
            self.last = self.render(self.turns)
        self.turns.append(turn)
        now = self.render(self.turns)
        same = len(self.last) if now.startswith(self.last) else len(commonprefix([self.last, now]))
        lost, self.last = len(self.last) - same, now
        return now[same:], lost


def conversation_spans(render: Callable[[list[Turn]], str], turns: list[Turn], window: int | None = None) -> list[tuple[str, int]]:
    """What each turn adds and rewrites; with a window only if whole prefixes prove it, else by whole prefixes."""
    if window is not None and len(turns) > window + 1:
        spans, found, size = Spans(render, window), [], 0
        digest = hashlib.sha256(render([]).encode("utf-8", "surrogatepass"))
        for k, turn in enumerate(turns, 1):
            added, lost = spans.add(turn)
            digest.update(added.encode("utf-8", "surrogatepass"))
            found.append((added, lost))
            size += lost
            if size or ((k & (k - 1) == 0 or k == len(turns)) and hashlib.sha256(render(turns[:k]).encode("utf-8", "surrogatepass")).digest() != digest.digest()):
                break
        else:
            return found
    spans = Spans(render, None)
    return [spans.add(t) for t in turns]


def format_conversations(
    conversations: DataFrame, template: Callable[[list[Turn]], str] = turn_template, reader: Callable[[str], tuple[str, int, int] | None] = read_turn,
    window: int | None = None, loss_role: str = "assistant",
) -> DataFrame:
    """One row for each turn, in order within its partition and conversation.

    (conv_id, nth, role, span, start, loss_start, loss_end, rewritten): span is
    what the turn adds to the output and start its place in it; the loss mask
    holds the characters of the turn's text if the role that is read back from
    the span is loss_role, else it is null; rewritten counts the characters of
    earlier output that the turn changed (0 for a template that only appends). A
    conversation's turns are held together while it is rendered.
    Turns go by turn, nulls last, then role and text; null roles and texts are
    empty; rows with a null conv_id are one conversation. Other columns are
    ignored.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text").drop("turn")
    names = ["conv_id", "nth", "role", "span", "start", "loss_start", "loss_end", "rewritten"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, turns, there, kind = None, [], False, None

        def done() -> pa.RecordBatch:
            out: list[list] = [[] for _ in names]
            at = 0
            for nth, ((role, _), (span, lost)) in enumerate(zip(turns, conversation_spans(template, turns, window), strict=True)):
                at -= lost
                got = reader(span)
                mask = (at + got[1], at + got[2]) if got and got[0] == loss_role else (None, None)
                for column, x in zip(out, (now, nth, got[0] if got else None, span, at, *mask, lost), strict=True):
                    column.append(x)
                at += len(span)
            return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(out, kinds, strict=True)], names=names)

        for b in batches:
            kind = b.schema.types[0]
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if there and conv != now:
                    yield done()
                    turns = []
                now, there = conv, True
                turns.append((role, text))
        if there:
            yield done()

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, nth long, role string, span string, start long, loss_start long, loss_end long, rewritten long")


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Digests of each conversation of format_conversations, read back from the spans in one pass over its rows."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]

    def run(batches):
        now, state, kind = None, None, None

        def done():
            values = (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names=names)

        for b in batches:
            kind = b.schema.types[0]
            for conv, nth, role, span, start, a, z, lost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if nth == 0:
                    if state:
                        yield done()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                got = read_turn(span)
                text = unescape(span[got[1]:got[2]]) if got else ""
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    loss = unescape(span[a - start:z - start])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] = start + len(span)
                state[5] += lost
        if state:
            yield done()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten long")


def op1_chat_formatting(spark, sf_dir) -> DataFrame:
    """Digests, read back from the output, of all conversations and conversation -7."""
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = format_conversations(read(spark, sf_dir, "conversations").select(own.columns).union(own), window=WINDOW)
    broken = F.raise_error(F.lit("the template rewrites earlier turns")).cast("boolean")
    return digest_conversations(turns).where(F.when(F.col("rewritten") > 0, broken).otherwise(True)).drop("rewritten")


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS shown,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS name
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn ASC NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn ASC NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ') + length(name) + length(': ') + length(shown) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
