"""Chat formatting over a prefix tree of conversations.

A conversation is a path of turns; conversations that share their first turns share the start of the
path.  Conversations are dealt over parts in the order of their paths, so that those with a common
start lie next to each other; within a part each turn of the tree is emitted once, depth first.  A
segment (one emitted turn) carries its tokens, the mask of the tokens to learn from, the position ids
it starts at (those of its path, not of the layout) and the intervals of the layout that its
ancestors take, which are all that its tokens may attend to besides earlier tokens of its own.

A turn is marked by the template's control strings.  In a text, escape signs are doubled
and one stands after the first character of every control string, so a formatted text holds control
strings only where turns begin and end, and unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.byte_bpe import KNOWN_PATTERN, text_encoder, token_bytes
from veilscan.llm.common import slices

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How a turn of each role begins and ends; unknown roles are written into ``other``."""

    begins: dict[str, str] = field(default_factory=lambda: {
        "system": "<<SYS>>", "user": "[INST] ", "assistant": " [ASST] "})
    ends: dict[str, str] = field(default_factory=lambda: {
        "system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"})
    #: For any other role, which stands escaped between the two parts; then the text, then the end.
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    learnt: str = "assistant"

    def controls(self) -> list[str]:
        found = {*self.begins.values(), *self.ends.values(), *self.other}
        return sorted({c.strip() for c in found} - {""}, key=lambda c: (-len(c), c))

    def escape(self, text: str) -> str:
        """Escape signs are doubled; one stands after the first character of a control string."""
        return _starts(tuple(self.controls())).sub(
            lambda m: m[0] + ESCAPE, text.replace(ESCAPE, 2 * ESCAPE))

    @staticmethod
    def unescape(text: str) -> str:
        """A doubled sign stands for one, a single sign for nothing."""
        return _SIGNS.sub(lambda m: m[1], text)

    def write(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before the text, the escaped text, and what stands after it."""
        if role in self.begins:
            return self.begins[role], self.escape(text), self.ends[role]
        begin, middle, end = self.other
        return begin + self.escape(role) + middle, self.escape(text), end

    def read(self, before: str, body: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        for role, begin in self.begins.items():
            if before == begin:
                return role, self.unescape(body)
        begin, middle, _ = self.other
        return self.unescape(before[len(begin):len(before) - len(middle)]), self.unescape(body)


_SIGNS = re.compile(re.escape(ESCAPE) + f"({re.escape(ESCAPE)}?)")


@lru_cache(maxsize=8)
def _starts(controls: tuple[str, ...]) -> re.Pattern:
    """The first character of every control string, also of ones that overlap."""
    return re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))


ROWS = ("part int, row long, conv_id long, depth int, role string, start long, length int, "
        "position long, learn_from int, learn_to int, text_from int, text_to int, tokens array<int>, "
        "ancestors array<struct<start:long,end:long>>")


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, sorted by turn, role and text; null role or text: empty.

    One conversation is one sequence and has to fit into a task.  Repeated rows are repeated turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))


def _with_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A turn's step on the path: a digest of all turns up to it."""
    for batch in slices(batches):
        paths = []
        for turns in batch.column("turns"):
            state, path = hashlib.blake2b(digest_size=16), []
            for turn in turns.as_py():
                for part in (turn["role"], turn["text"]):
                    data = part.encode()
                    state.update(len(data).to_bytes(8, "little") + data)
                path.append(state.digest())
            paths.append(path)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(paths, pa.list_(pa.binary()))], ["conv_id", "turns", "path"])


class _Layout:
    """Segments of one part, laid out in the order of the paths."""

    def __init__(self, part: int, template: Template, path: str):
        self.part, self.template = part, template
        self.encoder = text_encoder(path, KNOWN_PATTERN)
        self.at = self.row = 0
        # The path of the last conversation: (digest, start, end, position after it).
        self.open: list[tuple[bytes, int, int, int]] = []

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(text), np.int32)

    def _row(self, **columns) -> dict:
        self.row += 1
        return {"part": self.part, "row": self.row, **columns}

    def add(self, conv_id: int | None, turns: list[dict], path: list[bytes]) -> Iterator[dict]:
        shared = 0
        while shared < min(len(path), len(self.open)) and path[shared] == self.open[shared][0]:
            shared += 1
        del self.open[shared:]
        for depth in range(shared, len(path)):
            role = turns[depth]["role"]
            before, text, after = map(self._ids, self.template.write(role, turns[depth]["text"]))
            tokens = np.concatenate([before, text, after])
            learnt = role == self.template.learnt
            position = self.open[-1][3] if self.open else 0
            yield self._row(
                depth=depth, role=role, start=self.at, length=len(tokens), position=position,
                text_from=len(before), text_to=len(before) + len(text),
                learn_from=len(before) if learnt else 0,
                learn_to=len(before) + len(text) if learnt else 0,
                tokens=tokens, ancestors=self._intervals())
            end = self.at + len(tokens)
            self.open.append((path[depth], self.at, end, position + len(tokens)))
            self.at = end
        yield self._row(conv_id=conv_id, depth=len(path))

    def _intervals(self) -> list[dict]:
        """What the open turns take, neighbours joined."""
        found: list[dict] = []
        for _, start, end, _ in self.open:
            if found and found[-1]["end"] == start:
                found[-1]["end"] = end
            else:
                found.append({"start": start, "end": end})
        return found


def format_chats(turns: DataFrame, vocabulary: str, template: Template = Template(),  # noqa: B008
                 n_parts: int | None = None) -> DataFrame:
    """The tree's rows: segments in depth-first order and, after the last of its segments, a row
    for each conversation (``role`` null, ``depth``: its turns, all on the path that is open there).

    ``turns`` has ``conv_id, turn, role, text``; other columns are not read.  A part is one layout:
    ``start`` counts tokens from its beginning, ``position`` is the first position id, tokens from
    ``learn_from`` to ``learn_to`` are learnt, ``ancestors`` are the intervals that may be attended
    to.  Paths are dealt by range with the conversation's number, so a first turn, or a whole
    conversation, that very many share is spread over parts and emitted once in each.  A null
    ``conv_id`` is one conversation; equal conversations share all segments; an empty table gives
    no rows.
    """
    n_parts = n_parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = conversations(turns).mapInArrow(
        _with_path, "conv_id long, turns array<struct<turn:long,role:string,text:string>>, "
                    "path array<binary>")
    ordered = paths.repartitionByRange(n_parts, "path", "conv_id").sortWithinPartitions(
        "path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = None
        for batch in slices(batches, 128):
            layout = layout or _Layout(TaskContext.get().partitionId(), template, vocabulary)
            rows = [row for conv_id, found, path in zip(
                        batch.column("conv_id").to_pylist(), batch.column("turns"),
                        batch.column("path").to_pylist())
                    for row in layout.add(conv_id, found.as_py(), path)]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return ordered.mapInArrow(run, ROWS)


_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.schema([
    ("part", pa.int32()), ("row", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int32()),
    ("role", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("position", pa.int64()),
    ("learn_from", pa.int32()), ("learn_to", pa.int32()), ("text_from", pa.int32()),
    ("text_to", pa.int32()), ("tokens", pa.list_(pa.int32())), ("ancestors", pa.list_(_INTERVAL))])


def read_chats(rows: DataFrame, vocabulary: str, template: Template = Template(),  # noqa: B008
               n_parts: int | None = None) -> DataFrame:
    """Conversations out of the tree's rows alone: ``conv_id, turns`` (role, text), ``learnt`` (the
    unescaped texts under the mask, one after the other), ``formatted``.

    Rows of a part are read in order; only the open path is kept.
    """
    n_parts = n_parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(
        "part", "row", "conv_id", "depth", "learn_from", "learn_to", "text_from", "text_to",
        "role", "tokens").repartitionById(n_parts, F.col("part") % n_parts).sortWithinPartitions(
        "part", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        part, path = None, []
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, path = row["part"], []
                del path[row["depth"]:]
                if row["role"] is None:
                    for column, value in zip(out, (
                            row["conv_id"], [t for t, _, _ in path],
                            "".join(learnt for _, learnt, _ in path),
                            "".join(formatted for _, _, formatted in path))):
                        column.append(value)
                    continue
                ids = np.array(row["tokens"], np.int64)
                text = lambda a, b: table.join(ids[a:b]).decode()  # noqa: B023, E731
                role, body = template.read(
                    text(0, row["text_from"]), text(row["text_from"], row["text_to"]))
                path.append(({"role": role, "text": body},
                             template.unescape(text(row["learn_from"], row["learn_to"])),
                             text(0, None)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()),
                 pa.array(out[1], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                 pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                ["conv_id", "turns", "learnt", "formatted"])

    return ordered.mapInArrow(
        run, "conv_id long, turns array<struct<role:string,text:string>>, learnt string, "
             "formatted string")
