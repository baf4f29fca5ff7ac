"""Chat formatting in budgeted windows.

The turns of a conversation are laid into windows whose tokens fit a budget.  Prefix sums of the turns' tokens
choose how many new turns a window takes; each window starts with the system turn, if the conversation opens
with one, then repeats up to ``history`` earlier turns as far as they fit.  Repeated turns are masked: only
the text of an assistant turn at its first appearance is under the loss mask.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles every run ``<``, backslashes,
``|`` gets one more backslash, so that no text can hold a control string; reading takes it away again.  In roles,
backslashes and line breaks are escaped as well.

Conversations are read as sorted streams: a task holds one window, never a whole conversation, so a
conversation of any length passes in bounded memory.

Defined cases: null text and null role are empty; turns are ordered by turn, then role and text (nulls first), and
repeated rows are turns of their own; a turn over the budget has a window of its own; a null conv_id is a
conversation; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that the markers of a turn stand for.
MARKERS = 4
WINDOWS = "conv_id long, window int, repeated int, n_new int, n_tokens long, text string, loss array<struct<start:int,end:int>>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _windows(turns: Iterator[tuple], budget: int, history: int) -> Iterator[dict]:
    """Windows of (conv_id, role, text, tokens) rows that come sorted by conversation and turn."""

    def close():
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate(kept + new):
            head, body = f"{START}{_role(role)}\n", escape(text)
            if k >= len(kept) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        return {"conv_id": conv, "window": number, "repeated": len(kept), "n_new": len(new), "n_tokens": sum(t[2] for t in kept + new), "text": "".join(parts), "loss": loss}

    conv, number, system, past, kept, new, prefix = None, -1, None, deque(), [], [], 0
    for conv_id, role, text, tokens in turns:
        turn = (role, text, tokens)
        if number < 0 or conv_id != conv:
            if new:
                yield close()
            conv, number, past, kept, new, prefix = conv_id, 0, deque(maxlen=max(history, 1)), [], [], 0
            system = turn if role == "system" else None
        elif prefix + tokens > budget:
            yield close()
            number += 1
            kept, room = [], budget - tokens - (system[2] if system else 0)
            for old in reversed(past if history else ()):
                if old is system or old[2] > room:
                    break
                kept.insert(0, old)
                room -= old[2]
            kept = ([system] if system else []) + kept
            new, prefix = [], sum(t[2] for t in kept)
        new.append(turn)
        past.append(turn)
        prefix += tokens
    if new:
        yield close()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + 100
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_windows(turns: DataFrame, *, budget: int = 512, history: int = 2) -> DataFrame:
    """The windows of all conversations (columns conv_id, turn, role, text), as ``WINDOWS`` says.

    Rows of one conversation stand together and in order of their windows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (word_count(text) + MARKERS).alias("tokens"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        flat = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens"))))
        yield from _batches(_windows(flat, budget, history), schema)

    return ordered.mapInArrow(run, WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(_unrole(r), unescape(t)) for r, t in _TURN.findall(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """A row for each conversation, from its windows as they stand: turns and loss text, each once.

    ``windows`` must come as ``format_windows`` leaves them.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def told(batches):
        conv, state = None, None

        def done():
            n, turns, chars, loss, formatted, count = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted, "n_windows": count}

        for b in batches:
            for conv_id, repeated, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "repeated", "text", "loss"))):
                if state is None or conv_id != conv:
                    if state is not None:
                        yield done()
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    under = unescape(text[s["start"] : s["end"]])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
        if state is not None:
            yield done()

    return windows.mapInArrow(lambda batches: _batches(told(batches), schema), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
