"""Chat formatting in budgeted windows.

The turns of a conversation, in order, are cut into turn-aligned windows by prefix sums of their token counts: a window
takes turns until the sum since its start would pass the budget, and at least one.  Each window repeats the system turn
and a limited history of the turns before it.  Targets are the texts of assistant turns; those in the repeated history
are masked, so each target is under the loss mask once.

Rows are sorted within hash partitions of the conversation and read as a stream; only the open window and its history
are held, so a conversation of any length needs bounded memory.  Its turns go through one task, as its digest is a
hash of its whole text in order.

Defined cases: null text or role counts as empty; turns of equal number are ordered by role and text and all stay; a
turn longer than the budget has a window of its own and stays whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.llm.common import Scratch, small_batches, table

NAME = "op8_chat_formatting"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 4, 256

# Control strings of the template, and of templates that texts may imitate.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|<\|[a-z_]+\|>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>", re.S)

_NAMES = ["conv_id", "window", "text", "first_fresh", "loss"]
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SCHEMA = "conv_id {id}, window long, text string, first_fresh int, loss array<struct<start:int,end:int>>"


def escape(t: str) -> str:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", t.replace("\\", "\\\\"))


def unescape(t: str) -> str:
    return _ESCAPED.sub(r"\1", t)


def _head(role: str) -> str:
    return OPEN + escape(role).replace("\n", "\\n") + "\n"


def _role(head: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], head)


def tokens(text: str) -> int:
    """Tokens of a turn: its words and the two marks around it."""
    return len(text.encode(errors="surrogatepass").split()) + 2


class Window:
    """The open window of a conversation."""

    def __init__(self, conv, budget: int, turns: int, most: int):
        self.conv, self.budget, self.turns, self.most = conv, budget, turns, most
        self.number, self.system, self.kept, self.fresh = 0, None, [], []
        self.prefix = self.start = 0  # tokens up to now, and up to the start of the fresh turns
        self.room = budget
        self.past: deque = deque(maxlen=turns)

    def add(self, role: str, text: str):
        n = tokens(text)
        done = None
        if self.fresh and self.prefix + n - self.start > self.room:
            done = self.close()
        if not self.number and not self.fresh and role == "system":
            self.system = (role, text, n)
        self.fresh.append((role, text, n))
        self.prefix += n
        return done

    def close(self):
        """The window as a row; the next one starts with the system turn and the history."""
        parts, loss, at = [], [], 0
        repeated = self.kept
        for i, (role, text, _) in enumerate([*repeated, *self.fresh]):
            head, body = _head(role), escape(text)
            if role == "assistant" and i >= len(repeated):
                loss.append((at + len(head), at + len(head) + len(body)))
            parts.append(head + body + CLOSE)
            at += len(parts[-1])
        row = (self.conv, self.number, "".join(parts), len(repeated), loss)
        self.past.extend(self.fresh)
        if self.system is not None and self.past and self.past[0] is self.system:
            self.past.popleft()
        kept, total = [], 0
        for turn in reversed(self.past):
            total += turn[2]
            if total > self.most:
                break
            kept.append(turn)
        kept.reverse()
        self.kept = ([self.system] if self.system else []) + kept
        self.number, self.fresh, self.start = self.number + 1, [], self.prefix
        self.room = self.budget - sum(t[2] for t in self.kept)
        return row


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row for each window: conv_id, window, text, first_fresh (turns repeated before it), loss (spans in code points)."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def made(rows: list, id_type: pa.DataType) -> pa.RecordBatch:
        loss = pa.array([[{"start": a, "end": b} for a, b in r[4]] for r in rows], _LOSS)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int32()))), loss], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Window | None = None
        for b in batches:
            rows, id_type = [], b.column(0).type
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        rows.append(now.close())
                    now = Window(conv, budget, history_turns, history_tokens)
                if done := now.add(role, text):
                    rows.append(done)
            if rows:
                yield made(rows, id_type)
        if now:
            yield made([now.close()], id_type)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select("conv_id", "turn", text("role"), text("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    small_batches(turns.sparkSession)
    return rows.mapInArrow(run, SCHEMA.format(id=kind))


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a formatted window."""
    return [(_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done():
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def made(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *map(pa.array, columns[1:])], names)

        for b in batches:
            id_type = b.column(0).type
            for conv, text, first, loss in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        done()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[first:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode(errors="surrogatepass"))
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode(errors="surrogatepass"))
                now[5] += len(text)
            if rows:
                yield made(id_type)
        if now:
            done()
            yield made(id_type)

    rows = formatted.select(*_NAMES).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    shared = Scratch(spark)
    return digests(shared.put(windows(turns.unionByName(extra)), "windows"))
