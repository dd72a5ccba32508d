"""Chat formatting by incremental rendering of a template that is a black box.

A template is a function from turns to text. Successive prefixes of a conversation are rendered; what a
longer prefix adds to the text of the shorter one is the span of the new turn. If the shorter one is no
prefix of the longer, the template rewrites history, and the conversation is marked as such. Inside a span
the place of the turn's own text is found by rendering the turn with two probe texts: where the outputs
part is its start, what they share at the end follows it.

Rows are turns: they are ordered by turn, then role, then text, nulls first, within a conversation; a null
text or role is empty, a null conv_id is a conversation of its own, repeated rows are turns of their own.
An empty table gives an empty result, and other columns are not read. A conversation is streamed in the
order of its turns through one task, since what it is read back for (a digest) is sequential, but never
held whole: output comes in chunks of turns, and of a long conversation only as many turns are rendered
anew as the template may look back. For a template that may look back without bound (``memory=None``) all
earlier turns of the open conversation are kept. A template that declares how far it looks back is held to it: the
first 32 turns are rendered as whole prefixes, and whenever turns are forgotten, the next turn is rendered with and
without them; 32 turns are held for that before each power of two, eight more than declared elsewhere. A difference
fails the job. What a template shows of turns further back than those held, or only at other turns, is not found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import pa_schema, query, table

# Turns that a chunk of output holds at most.
CHUNK_TURNS = 64
PROBES = ("\x00", "\x01")

# What marks turns in this template and in widespread ones.
CONTROL = r"\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>"
TO_ESCAPE = re.compile(rf"([<\[])(\\*)(?={CONTROL})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={CONTROL})")
TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash into every control string, one more if there are some already."""
    return TO_ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


class Template(NamedTuple):
    """``render`` turns [(role, text)] into text; ``memory``: earlier turns a turn's rendering can depend on."""

    render: Callable[[list[tuple[str, str]]], str]
    memory: int | None = None
    escape: Callable[[str], str] = escape
    unescape: Callable[[str], str] = unescape


def render_marked(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|turn|>{escape_role(role)}\n{escape(text)}<|end|>\n" for role, text in turns)


MARKED = Template(render_marked, memory=0)


def read_marked(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a text that ``MARKED`` rendered."""
    for role, text in TURN.findall(formatted):
        yield unescape_role(role), unescape(text)


class Span(NamedTuple):
    """Where a turn lies in the formatted chunk, and the turn's own text in it (-1, -1 if not found there)."""

    start: int
    end: int
    text_start: int
    text_end: int


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


# Turns held beyond what the template needs, and those held where its declaration is put to the test.
HELD, TESTED = 8, 32


class Renderer:
    """The open conversation: the turns that may matter to the next one, and their rendering."""

    def __init__(self, template: Template, role_mask: str = "assistant"):
        self.template, self.mask = template, role_mask
        self.turns: list[tuple[str, str]] = []
        self.out, self.count = "", 0

    def span(self, before: str, turns: list[tuple[str, str]], turn: tuple[str, str]) -> tuple[str, int, str]:
        """The rendering with one turn more, where it parts from the one before, and what comes after."""
        out = self.template.render([*turns, turn])
        since = len(before) if out.startswith(before) else common_prefix(before, out)
        return out, since, out[since:]

    def room(self) -> int:
        # The first 32 turns are rendered as whole prefixes, and 32 turns before each power of two are held together.
        start = self.count < TESTED or (self.count + TESTED).bit_length() > self.count.bit_length()
        return TESTED if start else HELD

    def trim(self, turn: tuple[str, str]) -> None:
        """Forget turns the template cannot look back to, now and then, so that prefixes stay short.

        The declaration is tested each time: the next turn must add the same with and without the turns that go.
        """
        memory = self.template.memory
        if memory is None or len(self.turns) < 2 * memory + self.room():
            return
        kept = self.turns[len(self.turns) - memory :]
        short = self.template.render(kept) if kept else ""
        if self.span(self.out, self.turns, turn)[2] != self.span(short, kept, turn)[2]:
            raise ValueError(f"the template looks back further than the {memory} turns it declares, at turn {self.count}")
        self.turns, self.out = kept, short

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """What the turn adds, where in it its own text starts and ends, and whether history was rewritten."""
        self.trim((role, text))
        render = self.template.render
        out, since, span = self.span(self.out, self.turns, (role, text))
        rewritten = since < len(self.out)
        first, second = (render([*self.turns, (role, probe)]) for probe in PROBES)
        head = common_prefix(first, second) - since
        tail = len(first) - since - head - 1
        own = self.template.escape(text)
        if rewritten or head < 0 or len(span) != head + len(own) + tail or span[head : head + len(own)] != own:
            start = end = -1
        else:
            start, end = head, head + len(own)
        self.turns, self.out, self.count = [*self.turns, (role, text)], out, self.count + 1
        return span, start, end, rewritten


CHUNKS = (
    "conv_id {kind}, chunk long, formatted string, rewrites boolean, "
    "spans array<struct<start: bigint, end: bigint, text_start: bigint, text_end: bigint, loss: boolean>>"
)


def format_conversations(conversations: DataFrame, template: Template = MARKED, loss_role: str = "assistant") -> DataFrame:
    """Chunks of formatted conversations: conv_id, chunk, formatted, rewrites, spans.

    The chunks of a conversation joined in order are its formatted text; spans count from the start of their
    chunk, and ``loss`` marks the spans whose own text is under the loss mask. ``rewrites`` says that the
    template changed text it had given before; such turns have no text of their own (-1, -1) in the output.
    The chunks of one conversation are neighbours in one partition.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    schema = CHUNKS.format(kind=kind)
    types = pa_schema(conversations.sparkSession, schema)
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    turns = turns.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))

    def run(batches):
        open_id, renderer, chunk = object(), Renderer(template), 0
        texts, spans, length, rewrites = [], [], 0, False
        rows: list[dict] = []

        def close():
            nonlocal chunk, texts, spans, length, rewrites
            if spans:
                rows.append({"conv_id": open_id, "chunk": chunk, "formatted": "".join(texts), "rewrites": rewrites, "spans": spans})
                chunk, texts, spans, length, rewrites = chunk + 1, [], [], 0, False

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != open_id:
                    close()
                    open_id, renderer, chunk = conv, Renderer(template), 0
                added, start, end, rewritten = renderer.add(role or "", text or "")
                loss = role == loss_role and start >= 0
                spans.append({"start": length, "end": length + len(added), "text_start": length + start if start >= 0 else -1, "text_end": length + end if start >= 0 else -1, "loss": loss})
                texts.append(added)
                length, rewrites = length + len(added), rewrites or rewritten
                if len(spans) >= CHUNK_TURNS:
                    close()
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema=types)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return turns.mapInArrow(run, schema)


def read_back(formatted: DataFrame, template: Template = MARKED, read: Callable[[str], Iterator[tuple[str, str]]] = read_marked) -> DataFrame:
    """Per conversation, from its chunks alone: the digests of its turns and of the text under the loss mask.

    Takes what ``format_conversations`` gives, chunks of a conversation in order in one partition.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
    types = pa_schema(formatted.sparkSession, schema)

    def run(batches):
        state, rows = None, []

        def close():
            if state:
                state["turns_sha256"], state["loss_sha256"] = state["turns_sha256"].hexdigest(), state["loss_sha256"].hexdigest()
                rows.append(state)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    close()
                    state = {"conv_id": row["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "rewrites": False}
                text = row["formatted"]
                for role, own in read(text):
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{role}\n{own}\n".encode())
                for span in row["spans"]:
                    if span["loss"]:
                        own = template.unescape(text[span["text_start"] : span["text_end"]])
                        state["loss_chars"] += len(own)
                        state["loss_sha256"].update(own.encode())
                state["formatted_chars"] += len(text)
                state["rewrites"] |= row["rewrites"]
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=types)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return formatted.mapInArrow(run, schema)


PROBE_TEXT = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two turns hold control strings of well-known templates."""
    spark = conversations.sparkSession
    columns = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return columns.union(probe)


SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE_TEXT}' union all select -1, 1, 'assistant', '{PROBE_TEXT}'
), e as (
  -- a control string takes one more backslash
  select *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:{CONTROL})')) as shown,
         length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + len(regexp_extract_all(role, '[<\[]\\*(?:{CONTROL})')) as named
  from t
)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('<|turn|>') + named + 1 + shown + length('<|end|>') + 1) as bigint) as formatted_chars
from e group by conv_id
"""


@query("op2_chat_formatting", SQL)
def op2_chat_formatting(spark, sf):
    return read_back(format_conversations(with_probe(table(spark, sf, "conversations")))).drop("rewrites")
