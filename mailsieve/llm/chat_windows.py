"""Chat formatting in budgeted windows.

A conversation's turns, in order, are cut into windows of ``budget`` tokens of a public vocabulary (a path parameter)
at turn boundaries, found by binary search in the prefix sums of turn tokens. Every window repeats the system turn (if the conversation
opens with one) and as many of the latest turns as fit the history limit; repeated turns are not trained on.
History gives way to a turn that would not fit otherwise, oldest first, so a window exceeds the budget only where the
system turn and one turn together do; that turn stays whole, with no history beside it. Rows of a conversation are
streamed in order with one window in memory, so a very long conversation needs no more memory than a short one.

Control strings inside texts and roles are escaped: each backslash is doubled, then a backslash is put after
the first character of every control string. This can be undone exactly.

Defined results: null text and null role are empty; turns tie by role, then text; repeated rows are turns
of their own; rows with a null conversation id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
WINDOW_SCHEMA = "conv_id {id}, window int, n_repeated int, formatted string, loss_spans array<struct<start:int,end:int>>, n_tokens long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_counter(raw: bytes, pattern: str):
    """Counts the tokens of a turn as it is formatted, by a public byte-level vocabulary."""
    from .token_hist import encoding

    return lambda turn: len(encoding(raw, pattern).encode_ordinary(formatted_turn(*turn)))


def formatted_turn(role: str, text: str) -> str:
    return f"{OPEN}{ROLE}{escape(role)}{TEXT}{escape(text)}{CLOSE}"


def window_of(repeated: list[tuple[str, str]], new: list[tuple[str, str]], learn: str) -> tuple[str, list[dict]]:
    """Formatted text and the spans under the loss mask: texts of new turns of the role ``learn``."""
    parts, spans, at = [], [], 0
    for k, (role, text) in enumerate(repeated + new):
        head, body = f"{OPEN}{ROLE}{escape(role)}{TEXT}", escape(text)
        if k >= len(repeated) and role == learn and body:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts.append(head + body + CLOSE)
        at += len(parts[-1])
    return "".join(parts), spans


class _Conversation:
    """Turns not yet written, and what later windows repeat."""

    def __init__(self, conv_id, budget: int, history: int, learn: str, count):
        self.id, self.budget, self.limit, self.learn, self.count = conv_id, budget, history, learn, count
        self.system: list[tuple[tuple[str, str], int]] = []
        self.history: list[tuple[tuple[str, str], int]] = []
        self.waiting: list[tuple[tuple[str, str], int]] = []
        self.sums = [0]
        self.repeated_size = 0
        self.window = 0
        self.seen = 0

    def add(self, role: str, text: str) -> Iterator[dict]:
        turn = (role, text), self.count((role, text))
        if self.seen == 0 and role == "system":
            self.system = [turn]
        self.seen += 1
        self.waiting.append(turn)
        self.sums.append(self.sums[-1] + turn[1])
        if len(self.waiting) == 1:
            self.make_room()
        while self.sums[-1] > self.room():
            yield self.cut()

    def make_room(self) -> None:
        """Drops history that the first waiting turn would not fit beside; what is repeated is settled then."""
        while self.window and self.history and self._size(self.system + self.history) + self.waiting[0][1] > self.budget:
            del self.history[0]
        self.repeated_size = self._size(self.system + self.history) if self.window else 0

    @staticmethod
    def _size(turns: list[tuple[tuple[str, str], int]]) -> int:
        return sum(n for _, n in turns)

    def room(self) -> int:
        return max(1, self.budget - self.repeated_size)

    def cut(self) -> dict:
        n = max(1, bisect_right(self.sums, self.room()) - 1)
        repeated, new = self.system + self.history if self.window else [], self.waiting[:n]
        text, spans = window_of([t for t, _ in repeated], [t for t, _ in new], self.learn)
        out = {"conv_id": self.id, "window": self.window, "n_repeated": len(repeated), "formatted": text, "loss_spans": spans, "n_tokens": self.repeated_size + self.sums[n]}
        rest = self.history + (new[1:] if self.window == 0 and self.system else new)
        left, self.history = self.limit, []
        for turn in reversed(rest):
            left -= turn[1]
            if left < 0:
                break
            self.history.insert(0, turn)
        self.waiting = self.waiting[n:]
        self.sums = [0, *accumulate(n for _, n in self.waiting)]
        self.window += 1
        if self.waiting:
            self.make_room()
        return out

    def end(self) -> Iterator[dict]:
        while self.waiting:
            yield self.cut()


def windows(turns: DataFrame, budget: int = 512, history: int = 96, learn: str = "assistant", vocabulary: str | None = None) -> DataFrame:
    """conv_id, window, n_repeated, formatted, loss_spans, n_tokens of the turns (conv_id, turn, role, text)."""
    import public_tokenizers

    from .common import _arrow_schema, begin_task, end_task
    from .token_hist import default_vocabulary

    with open(vocabulary or default_vocabulary(), "rb") as f:
        ranks, pattern = turns.sparkSession.sparkContext.broadcast(f.read()), public_tokenizers.PATTERN
    owner = uuid.uuid4().hex
    schema = WINDOW_SCHEMA.format(id=dict(turns.dtypes)["conv_id"])
    arrow = _arrow_schema(turns.sparkSession, schema)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        now, out, count = None, [], turn_counter(ranks.value, pattern)
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.id != conv_id:
                    out += now.end() if now else []
                    now = _Conversation(conv_id, budget, history, learn, count)
                out += now.add(role, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now and (out := list(now.end())):
            yield pa.RecordBatch.from_pylist(out, arrow)
        end_task()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse windows and digest what they hold, one row a conversation.

    A conversation's windows are brought together and put in order first, so the windows may have been saved, read and
    dealt out anew in between.
    """
    from .common import _arrow_schema

    schema = f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    arrow = _arrow_schema(formatted.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        done = lambda s: {"conv_id": s["id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["long"], "n_windows": s["windows"]}
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["id"]:
                    out += [done(now)] if now else []
                    now = {"id": row["conv_id"], "n": 0, "chars": 0, "long": 0, "windows": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                text = row["formatted"]
                for k, m in enumerate(TURN.finditer(text)):
                    if k >= row["n_repeated"]:
                        now["n"] += 1
                        now["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for s in row["loss_spans"]:
                    part = unescape(text[s["start"] : s["end"]])
                    now["chars"] += len(part)
                    now["loss"].update(part.encode())
                now["long"] += len(text)
                now["windows"] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now:
            yield pa.RecordBatch.from_pylist([done(now)], arrow)

    return formatted.select("conv_id", "window", "n_repeated", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, schema)
