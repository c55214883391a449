r"""Chat formatting (operator 5): budgeted, turn-aligned windows with a loss mask.

Each conversation's turns are measured in tokens; prefix sums of them choose spans of whole turns: a window
takes turns while the sum stays within `budget`. The first system turn of a conversation, wherever it stands,
is repeated at the head of every window after its own, followed by up to `history` tokens of the turns before
the span, both without loss; assistant turns inside the span itself bear the loss, so each is a target exactly
once. A turn that with the system turn is larger than the budget gets a window of its own.

    <turn "user">
    text
    </turn>

Control strings inside a text (`<turn`, `</turn`, `###`) and backslashes are escaped with a backslash, roles
are JSON strings: `parse` gives back exactly what went in.

Rows are sorted by conversation and turn and streamed: state is one window, never a conversation; a very
long text is one turn and must fit in a task. Null texts and roles count as empty; a null turn comes first,
ties are ordered by role and text; rows with a null conv_id are one conversation. Repeated rows are turns like
any other. Extra columns are ignored, whatever their names; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import table

BUDGET = 512
HISTORY = 128
#: Tokens that the marks of a turn cost.
MARKS = 6
_CONTROL = re.compile(r"\\|</?turn|###")
_ESCAPED = re.compile(r"\\(\\|</?turn|###)")
_HEAD = re.compile(r'<turn ("(?:[^"\\]|\\.)*")>\n')
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def n_tokens(text: str) -> int:
    """Words and single marks; any other counter can be passed to `Formatter`."""
    return sum(1 for _ in _TOKEN.finditer(text))


def render(role: str, text: str) -> tuple[str, str, str]:
    return f"<turn {json.dumps(role)}>\n", escape(text), "\n</turn>\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of every turn."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        end = formatted.index("\n</turn>\n", head.end())
        out.append((json.loads(head[1]), unescape(formatted[head.end() : end]), head.end(), end))
        at = end + len("\n</turn>\n")
    return out


class Formatter:
    """Turns of one conversation, in order, to windows."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY, count=n_tokens):
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple[str, str, int] | None = None  # once the window in which it first stands is closed
        self.late: tuple[str, str, int] | None = None  # until then
        self.past: list[tuple[str, str, int]] = []  # turns before the span, at most `history` tokens
        self.span: list[tuple[str, str, int]] = []
        self.lead = 0  # tokens of what is repeated
        self.sum = 0  # prefix sum inside the span
        self.windows = 0

    def _repeated(self) -> list[tuple[str, str, int]]:
        return ([self.system] if self.system else []) + self.past

    def add(self, role: str, text: str) -> Iterator[dict]:
        turn = (role, text, self.count(text) + MARKS)
        if self.span and self.lead + self.sum + turn[2] > self.budget:
            yield self._close()
        if not self.span:
            while self.past and sum(t[2] for t in self._repeated()) + turn[2] > self.budget:
                self.past.pop(0)
            self.lead = sum(t[2] for t in self._repeated())
        if role == "system" and self.system is None and self.late is None:
            self.late = turn
        self.span.append(turn)
        self.sum += turn[2]

    def finish(self) -> Iterator[dict]:
        if self.span:
            yield self._close()

    def _close(self) -> dict:
        text, loss, n_repeated = [], [], 0
        at = 0
        head = self._repeated()
        for i, (role, body, _) in enumerate(head + self.span):
            a, b, c = render(role, body)
            if i >= len(head) and role == "assistant":
                loss.append({"lo": at + len(a), "hi": at + len(a) + len(b)})
            text += [a, b, c]
            at += len(a) + len(b) + len(c)
        n_repeated = len(head)
        out = {"window": self.windows, "formatted": "".join(text), "loss": loss, "n_repeated": n_repeated, "n_tokens": self.lead + self.sum}
        self.system = self.system or self.late
        kept, total = [], 0
        for t in reversed(self.past + self.span):
            if t is self.system:
                continue
            if total + t[2] > self.history:
                break
            kept.append(t)
            total += t[2]
        self.past, self.span, self.sum = kept[::-1], [], 0
        self.windows += 1
        return out


_FORMATTED = "conv_id long, window long, formatted string, loss array<struct<lo:long,hi:long>>, n_repeated long, n_tokens long"
_LOSS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_NAMES = ["conv_id", "window", "formatted", "loss", "n_repeated", "n_tokens"]
_TYPES = (pa.int64(), pa.int64(), pa.string(), _LOSS, pa.int64(), pa.int64())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _format(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _NAMES]
        size = 0
        for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
            f = Formatter(budget, history)

            def windows(turns=turns, f=f) -> Iterator[dict]:
                for _, role, text in turns:
                    yield from f.add(role or "", text or "")
                yield from f.finish()

            for w in windows():
                for c, v in zip(out, (conv, *(w[k] for k in _NAMES[1:])), strict=True):
                    c.append(v)
                size += len(w["formatted"])
                if size > 1 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=_NAMES)
                    out, size = [[] for _ in _NAMES], 0
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=_NAMES)

    return run


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conversations(conv_id, turn, role, text) to one row for each window, sorted inside partitions."""
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(budget, history), _FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order to one row for each conversation, from the formatted text and the mask alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    out: list[list] = [[] for _ in names]
    for conv, windows in groupby(_rows(batches), key=lambda r: r[0]):
        turns, loss, n, n_loss, n_chars, n_windows = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
        for _, _, formatted, mask, repeated, _ in windows:
            for role, text, _, _ in parse(formatted)[repeated:]:
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for m in mask:
                part = unescape(formatted[m["lo"] : m["hi"]])
                loss.update(part.encode())
                n_loss += len(part)
            n_chars += len(formatted)
            n_windows += 1
        for c, v in zip(out, (conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, n_windows), strict=True):
            c.append(v)
        if len(out[0]) >= 4096:
            yield pa.record_batch([pa.array(c, pa.string() if "sha" in k else pa.int64()) for k, c in zip(names, out, strict=True)], names=names)
            out = [[] for _ in names]
    yield pa.record_batch([pa.array(c, pa.string() if "sha" in k else pa.int64()) for k, c in zip(names, out, strict=True)], names=names)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return format_conversations(rows).mapInArrow(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long",
    )
