"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string.  Successive prefixes of a
conversation are rendered; where the output for k turns starts with the output for k-1, the rest is
the span of turn k.  Where it does not, the template rewrote history, and the turn says so.  Inside
a span, the text is located by rendering the same prefix with a marker in place of the last text.

Prefixes are whole, so time grows with the square of a conversation's length.  Only a template that is
declared `local` (what it writes for a turn depends on the turn before it only, and on whether there is
one) is rendered in windows of `context` turns that overlap by one.  A window is given out when it has been
checked, at its end or at that of the conversation: the whole conversation so far is rendered, and must be the
checked output before with the window's pieces behind it.  Otherwise the window is rendered again by whole
prefixes, as is all that follows, so a wrong declaration costs time and the pieces of every conversation end to end
are its output.  What a template declared local rewrites within a window and takes back before its end is not seen.

Empty table: no rows.  Null text or role: empty.  A null conv_id is a conversation of its own.  Turns
that share a number are ordered by role and text; repeated rows are separate turns.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MARK = "\ue000here\ue001"
Template = Callable[[list[tuple[str, str]]], str]


def escape(text: str) -> str:
    """Reversible; the result holds no control string: a backslash is doubled and `<|` is broken up."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S)


def local(template: Template) -> Template:
    """Declares a template local."""
    template.local = True
    return template


@local
def chat_template(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of one turn as `chat_template` wrote it."""
    head, _, body = piece.removeprefix(START).partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head, flags=re.S)
    return role, unescape(body[: body.rindex(END)])


Turn = tuple[str, str]
Piece = tuple[str, int, int, bool]


class Prefixes:
    """Feeds turns to a template one by one, after those of `turns`, and gives each one's piece of the output."""

    def __init__(self, template: Template, turns: list[Turn]):
        self.template, self.turns = template, list(turns)
        self.last = template(self.turns)

    def add(self, role: str, text: str) -> Piece:
        """The piece of this turn, where its text starts and ends in the piece (-1: not found), rewritten or not."""
        self.turns.append((role, text))
        now = self.template(self.turns)
        rewritten = not now.startswith(self.last)
        piece = now if rewritten else now[len(self.last) :]
        marked = self.template([*self.turns[:-1], (role, MARK)])
        before, found, after = marked.rpartition(MARK)
        known = found and now.startswith(before) and now.endswith(after) and len(now) >= len(before) + len(after)
        base = len(now) - len(piece)
        start, end = (len(before) - base, len(now) - len(after) - base) if known else (-1, -1)
        self.last = now
        return piece, start, end, rewritten


class Spans:
    """The pieces of one conversation's turns, in order; those of a window come together."""

    def __init__(self, template: Template, context: int):
        self.template, self.context = template, context
        self.plain = None if getattr(template, "local", False) else Prefixes(template, [])
        self.window = Prefixes(template, []) if self.plain is None else None
        self.done: list[Turn] = []  # checked turns, and their output
        self.output = self.window.last if self.window else ""
        self.held: list[tuple[Turn, Piece]] = []

    def add(self, role: str, text: str) -> list[Piece]:
        if self.plain:
            return [self.plain.add(role, text)]
        self.held.append(((role, text), self.window.add(role, text)))
        return self.rest() if len(self.held) == self.context else []

    def rest(self) -> list[Piece]:
        """The pieces of the turns that are still held."""
        turns, pieces = [t for t, _ in self.held], [p for _, p in self.held]
        if not turns:
            return []
        self.held = []
        whole = self.template([*self.done, *turns])
        if not any(p[3] for p in pieces) and whole == self.output + "".join(p[0] for p in pieces):
            self.done, self.output = [*self.done, *turns], whole
            self.window = Prefixes(self.template, turns[-1:])
            return pieces
        self.plain, self.window = Prefixes(self.template, self.done), None  # not local after all
        return [self.plain.add(*t) for t in turns]


FORMATTED = "conv_id long, seq long, role string, piece string, text_start long, text_end long, rewritten boolean"


def formatted(conversations: DataFrame, template: Template = chat_template, context: int = 64) -> DataFrame:
    """One row for each turn, sorted within its partition by conversation and turn; `context` is for local
    templates only.  The output for a conversation is its pieces laid end to end; text_start and text_end are offsets in the piece."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, spans, waiting, seq = object(), None, [], 0
        out: dict[str, list] = {k: [] for k in SCHEMA.names}

        def give(pieces: list[Piece]) -> None:
            nonlocal seq
            for piece in pieces:
                for k, v in zip(out, (conv, seq, waiting.pop(0), *piece), strict=True):
                    out[k].append(v)
                seq += 1

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    if spans:
                        give(spans.rest())
                    conv, spans, waiting, seq = c, Spans(template, context), [], 0
                waiting.append(role)
                give(spans.add(role, text))
            if out["seq"]:
                yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)
                out.update({k: [] for k in out})
        if spans:
            give(spans.rest())
            if out["seq"]:
                yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)

    SCHEMA = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("rewritten", pa.bool_())])
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(render, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_turns long"


def digests(rows: DataFrame, parser: Callable[[str], tuple[str, str]] = parse, unescaper: Callable[[str], str] = unescape, loss_role: str = "assistant") -> DataFrame:
    """Reads conversations back from the pieces of `formatted` (which must keep their order)."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None
        for batch in batches:
            out = []
            cols = [batch.column(k).to_pylist() for k in ("conv_id", "piece", "text_start", "text_end", "rewritten")]
            for c, piece, start, end, rewritten in zip(*cols, strict=True):
                if c != conv:
                    if state:
                        out.append(state)
                    conv, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = parser(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role == loss_role:
                    masked = unescaper(piece[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
                state[6] += rewritten
            if out:
                yield told(out)
        if state:
            yield told([state])

    def told(states: list) -> pa.RecordBatch:
        cols = list(zip(*[[s.hexdigest() if hasattr(s, "hexdigest") else s for s in row] for row in states], strict=True))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return rows.mapInArrow(read_back, DIGEST)
