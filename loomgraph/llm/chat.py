"""Chat formatting into budgeted windows.

A conversation's turns are laid out in a chat template; running sums of the turns' tokens choose the windows: each holds the system turn, a
limited run of turns repeated from before as history, and as many new whole turns as the budget allows. The turns
that a window may be trained on are the assistant's new ones: those repeated as history, the system's and the user's are masked, so every assistant turn
is a target exactly once.

Turns are shuffled once, by conversation, and sorted there; a task then reads its turns as a stream and holds one window and its
history at a time, both bounded by the budget, so a conversation may have any number of turns.

Nothing in a text can pass for a mark of the template: every "<", backslashes, "|" in it gets one more backslash (``unescape`` takes it
away), and characters of a role other than letters, digits, "_", "." and "-" become "_" in the text.

Defined results: a null or empty role counts as "user", a null text as ''. Turns are taken in the order of (turn, role, text), null numbers first, repeated
rows as separate turns. A turn with a null conversation id is a conversation by itself. Only a system turn that comes first is retained; others are
ordinary, masked turns. A turn that with the system turn exceeds the budget has a window to itself, without history, marked ``over_budget``; it is
never cut. A conversation of only a system turn gives one window without new turns. An empty table gives an empty result. Columns
other than the four named ones aren't read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_arrow
from loomgraph.llm.tokens import TOKENIZERS, encode, rank_path

SCHEMA = "conv_id bigint, window int, history_from int, turn_from int, turn_to int, n_tokens bigint, n_target_tokens bigint, over_budget boolean, text string, segments array<struct<turn: int, role: string, start: int, stop: int, is_target: boolean>>"

#: Characters of finished windows after which a batch is sent on.
OUT_CHARS = 2 << 20


@dataclass(frozen=True)
class ChatParams:
    """``budget``: tokens of a window; ``history``: tokens of it that repeated turns may take."""

    budget: int = 1024
    history: int = 256
    tokenizers: str = TOKENIZERS


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(role: str, text: str) -> str:
    return f"<|{re.sub(r'[^\w.-]', '_', role)}|>\n{escape(text)}\n<|end|>\n"


@dataclass
class _Turn:
    number: int
    role: str
    text: str
    tokens: int


class Conversation:
    """Takes the turns of one conversation in order; gives its windows as they close: (system turn or None, turns, number of the first new one)."""

    def __init__(self, path: str, params: ChatParams):
        self.path, self.params = path, params
        self.system: _Turn | None = None
        self.room, self.n = params.budget, 0
        self.window: list[_Turn] = []
        self.sum = self.new_from = self.kept = self.windows = 0
        self.recent: deque[_Turn] = deque()  # the turns before the next one that fit the history

    def _close(self):
        self.windows += 1
        return self.system, self.window, self.new_from

    def add(self, role: str, text: str) -> Iterator[tuple]:
        laid = render(role, text)
        turn = _Turn(self.n, role, laid, len(encode(self.path, laid)))
        self.n += 1
        if turn.number == 0 and role == "system":
            self.system, self.room = turn, max(0, self.room - turn.tokens)
            return
        if self.window and self.sum + turn.tokens <= self.room:
            self.window.append(turn)
            self.sum += turn.tokens
        else:
            if self.window:
                yield self._close()
            old = list(self.recent) if turn.tokens <= self.room else []
            total = turn.tokens + sum(t.tokens for t in old)
            while old and total > self.room:
                total -= old.pop(0).tokens
            self.window, self.sum, self.new_from = [*old, turn], total, turn.number
        self.recent.append(turn)
        self.kept += turn.tokens
        while self.kept > max(0, min(self.params.history, self.room)):
            self.kept -= self.recent.popleft().tokens

    def end(self) -> Iterator[tuple]:
        if self.window or self.system and not self.windows:
            if not self.window:
                self.new_from = 1
            yield self._close()


class _Rows:
    """Finished windows by column."""

    def __init__(self, budget: int):
        self.budget, self.chars, self.cols, self.segments, self.counts = budget, 0, [[] for _ in range(9)], [[] for _ in range(5)], []

    def add(self, conv: int | None, number: int, system: _Turn | None, turns: list[_Turn], new_from: int) -> None:
        at = target = n = 0
        used = [system, *turns] if system else turns
        for t in used:
            fresh = t.number >= new_from and t.role == "assistant" and t is not system
            target += t.tokens if fresh else 0
            n += t.tokens
            for c, v in zip(self.segments, (t.number, t.role, at, at + len(t.text), fresh)):
                c.append(v)
            at += len(t.text)
        first = turns[0].number if turns else new_from
        last = turns[-1].number + 1 if turns else new_from
        for c, v in zip(self.cols, (conv, number, first, new_from, last, n, target, n > self.budget, "".join(t.text for t in used))):
            c.append(v)
        self.counts.append(len(used))
        self.chars += at

    def take(self) -> pa.RecordBatch:
        fields = [pa.field(n, t) for n, t in zip(("turn", "role", "start", "stop", "is_target"), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()))]
        parts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(self.segments, fields)], fields=fields)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.counts)]), pa.int32()), parts)
        types = (pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.bool_(), pa.string())
        out = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(self.cols, types)), lists], names=NAMES)
        self.__init__(self.budget)
        return out


NAMES = ["conv_id", "window", "history_from", "turn_from", "turn_to", "n_tokens", "n_target_tokens", "over_budget", "text", "segments"]


def windows(docs: DataFrame, params: ChatParams = ChatParams(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """SCHEMA: one row for each window; segments give each turn's characters in ``text``. ``turn_from``/``turn_to`` number turns from 0 by order."""
    path = rank_path(params.tokenizers)
    role = F.when(F.col(role_col) != "", F.col(role_col)).otherwise("user")
    turns = docs.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    # turns without a conversation are spread by their content: they need no common task
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0).cast("bigint"))
    turns = turns.withColumn("spread", spread).repartition("conv_id", "spread").sortWithinPartitions("conv_id", "spread", "turn", "role", "text")

    def run(it):
        rows, conv, now = _Rows(params.budget), None, None

        def put(closed):
            for w in closed:
                rows.add(conv, now.windows - 1, *w)

        for whole in it:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                    if now is None or c is None or c != conv:
                        if now is not None:
                            put(now.end())
                        conv, now = c, Conversation(path, params)
                    put(now.add(role, text))
                    if rows.chars > OUT_CHARS:
                        yield rows.take()
        if now is not None:
            put(now.end())
        if rows.counts:
            yield rows.take()

    return map_arrow(turns.select("conv_id", "role", "text"), run, SCHEMA)
