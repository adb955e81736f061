"""Chat formatting from event logs.

A log has events (conv_id, seq, kind, message_id, role, text). Partitioned by conversation and sorted by sequence,
events are folded into final messages, which are rendered by a template as text with a loss mask:

- message: a new message with this text. Its message_id, if any, can be meant by later events.
- delta: more text at the end of a message; the first of a message opens it.
- edit: a message's text is this instead.
- regenerate: a message's text is thrown away, and deltas start it anew; messages after it go too.
- delete: a message goes.

Events of any other kind, or of none, change nothing.

The fold streams over a partition's sorted rows. Messages that no later event can mean are rendered as soon as
they fill a piece of a bounded size, so a conversation of any length passes in bounded memory; from the first
message with an id on, the messages of that conversation are held to its end. A conversation is rows (conv_id,
part, ...), of which nearly all have one; what is read back runs over the parts as they come. Digests over a
whole conversation are one chain by nature, so its rows pass through one task, one after another.

The template marks turns as in PARTS. In texts, a backslash follows the first character of every control string,
and backslashes are doubled; so no text holds a control string, and texts can be read back exactly.

Null texts and roles are empty. A null conv_id is a conversation of its own. Rows with equal seq are in order of
kind, role and text; a null seq comes first. Repeated message rows are messages each. Events that mean a message that isn't there
open one (delta, edit, regenerate) or do nothing (delete). Other columns of the log are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import map_batches

BEGIN = "<s>"
#: What stands before and after a turn's text, by role; other roles are named in theirs.
PARTS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
KINDS = frozenset(("message", "delta", "edit", "regenerate", "delete"))
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
_ESCAPE = re.compile("|".join([r"\\", *(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True))]))
#: Code points of a piece, beyond which the next turn begins another.
PIECE = 1 << 22


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m.group() == "\\" else f"{m.group()[0]}\\{escape(m.group()[1:])}", text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(\\?)", r"\1", text)


def render(messages: list[tuple[str, str]], first: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """Text of the turns (role, text), and the spans of the assistant's words in it."""
    out, at, mask = [BEGIN] if first else [], len(BEGIN) if first else 0, []
    for role, text in messages:
        body = escape(text)
        if role in PARTS:
            before, after = PARTS[role]
        else:
            before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        if role == "assistant":
            mask.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), mask


def parse(text: str, first: bool = True) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a rendered text."""
    at = len(BEGIN) if first else 0
    while at < len(text):
        if text.startswith(OTHER[0], at):
            mid = text.index(OTHER[1], at)
            end = text.index(OTHER[2], mid)
            yield unescape(text[at + len(OTHER[0]) : mid]), unescape(text[mid + len(OTHER[1]) : end])
            at = end + len(OTHER[2])
            continue
        role = next((r for r in ("user", "system") if text.startswith(PARTS[r][0], at)), "assistant")
        before, after = PARTS[role]
        end = text.index(after, at + len(before))
        yield role, unescape(text[at + len(before) : end])
        at = end + len(after)


class Fold:
    """The messages of one conversation so far."""

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}
        self.n = self.size = self.part = 0
        #: No message with an id so far: all there are stay as they are.
        self.final = True

    def add(self, kind: str, message_id: str | None, role: str, text: str) -> None:
        if kind not in KINDS:
            return
        self.n += 1
        self.size += len(text)
        self.final &= message_id is None
        key = (message_id,) if message_id is not None else self.n
        held = self.messages.get(key)
        if kind == "message" or (held is None and kind in ("delta", "edit", "regenerate")):
            while key in self.messages:
                key = (key, self.n)
            self.messages[key] = [role, [text]]
        elif held is None:
            return
        elif kind == "delta":
            held[1].append(text)
        elif kind == "edit":
            held[1] = [text]
        elif kind == "delete":
            del self.messages[key]
        elif kind == "regenerate":
            keys = list(self.messages)
            for k in keys[keys.index(key) + 1 :]:
                del self.messages[k]
            held[1] = [text]

    def pieces(self, most: int, end: bool) -> Iterator[tuple[int, str, list]]:
        """(part, text, mask) of what is held, which is then held no more."""
        turns, size = [], 0
        for role, texts in self.messages.values():
            turns.append((role, "".join(texts)))
            size += len(turns[-1][1])
            if size >= most:
                yield self.part, *render(turns, not self.part)
                self.part, turns, size = self.part + 1, [], 0
        if turns or (end and not self.part):
            yield self.part, *render(turns, not self.part)
            self.part += 1
        self.messages, self.size = {}, 0


MASK = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: What makes up an event, in the order of ties.
EVENT = ("conv_id", "seq", "kind", "role", "text", "message_id")


def format_chats(events: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, part, text, mask) of all conversations of a log with the columns of EVENT."""
    rows = events.select(*EVENT).repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in EVENT))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("mask", MASK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            conv, part, text, mask = zip(*out)
            spans = [[{"start": a, "end": b} for a, b in m] for m in mask]
            return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(part, pa.int32()), pa.array(text, pa.string()), pa.array(spans, _MASK)], names=["conv_id", "part", "text", "mask"])

        def rendered(conv: object, fold: Fold, end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            for x in fold.pieces(piece, end):
                out.append((conv, *x))
                size += len(x[1])
                if size >= piece:
                    yield batch()
                    out, size = [], 0

        fold, conv, kind = None, None, None
        for b in batches:
            kind = b.column(0).type
            for c, _, k, role, text, message_id in zip(*(x.to_pylist() for x in b.columns)):
                if fold is None or c != conv:
                    if fold:
                        yield from rendered(conv, fold, True)
                    fold, conv = Fold(), c
                fold.add(k, message_id, role or "", text or "")
                if fold.final and fold.size >= piece:
                    yield from rendered(conv, fold, False)
        if fold:
            yield from rendered(conv, fold, True)
        if out:
            yield batch()

    return map_batches(rows, run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted texts hold, read from them: a row for each conversation, without a shuffle.

    turns_sha256 is of role, newline, text, newline for each turn; loss_sha256 of what is under the mask.
    """
    fields = [formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in fields]
        state: list | None = None

        def batch(rows: list[list]) -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in turns]), pa.array(chars, pa.int64()), pa.array([h.hexdigest() for h in loss]), pa.array(size, pa.int64())], names=names)

        for b in batches:
            kind = b.column(0).type
            done = []
            for conv, part, text, mask in zip(*(x.to_pylist() for x in b.columns)):
                if not part:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, words in parse(text, not part):
                    state[1] += 1
                    state[2].update(f"{role}\n{words}\n".encode())
                for span in mask:
                    words = unescape(text[span["start"] : span["end"]])
                    state[3] += len(words)
                    state[4].update(words.encode())
                state[5] += len(text)
            if done:
                yield batch(done)
        if state:
            yield batch([state])

    return map_batches(formatted, run, T.StructType(fields))
