"""Byte-level BPE as a lazily determinised transducer, and its streaming inverse.

Encoding.  The merges fix one sequence of tokens for every prefix of a piece; a sequence is that of
its bytes exactly when each neighbouring pair of its tokens is (the two tokens' joined bytes merge
back into these two).  So the nondeterministic machine keeps one hypothesis per earlier position
that a token may still start from: a node of the vocabulary's trie, and the last token before that
position.  A state of the deterministic machine is the set of these hypotheses; its output at a byte
is the last token of the prefix that ends there.  Going back over the outputs gives the tokens; those
that all live hypotheses share are emitted, so a token leaves after a lookahead of at most the
longest token's bytes, or at the end of a window of bytes.  States and transitions are made when
first met and kept in a bounded table.

Decoding.  Tokens are byte strings that may end within a character; a state machine over UTF-8 lead
and continuation bytes says how many bytes at the end of a chunk have to wait for the next one.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilscan.llm.common import slices

#: Kept pieces (in each of two generations), and states and pairs of the transducer; a table that
#: is full starts afresh, which costs time only.
MAX_KEPT = 125_000
MAX_STATES = 250_000
#: Stands for the token before the first one; tokens are packed into 20 bits.
NO_TOKEN = (1 << 20) - 1
#: Longer pieces run through the transducer each time instead of being kept.
MAX_KEPT_PIECE = 64
#: Bytes after which the transducer emits what is settled.
WINDOW = 4096
DECODE_CHUNK = 65_536

#: The pattern of public vocabularies, and the same for texts of common Latin characters alone,
#: whose classes the faster standard library can state.
KNOWN_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                 r"|\s+(?!\S)|\s+")
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+"
                 r"|\s+(?!\S)|\s+")
BEYOND_PLAIN = re.compile("[^\t-\r -~¡-©«-±´¶·¸»¿-ɏ‘’“”–—…]").search


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _packed(numbers: list[int]) -> bytes:
    return array("q", numbers).tobytes()


def _unpacked(data: bytes) -> array:
    return array("q", data)


class BpeTransducer:
    """Encodes the bytes of one piece into ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        # Trie: children by node * 256 + byte; depth of a node; the rank of a node that is a token.
        self.child: dict[int, int] = {}
        self.rank_at: dict[int, int] = {}
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.rank_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.kept: dict[bytes, tuple[dict, int, bytes]] = {}
        self._forget()

    def _forget(self) -> None:
        # A state is the bytes of packed (trie node, last token before it), eight for each live
        # position, the oldest first.  It is kept as (row, size of its last token, that token's rank
        # as bytes); a row maps a byte to what is kept of the next state, and under -1 has its own.
        for row, _, _ in self.kept.values():
            row.clear()  # rows refer to each other
        self.kept.clear()
        self.pairs: dict[int, bool] = {}
        self.start = self._keep(_packed([NO_TOKEN]), 0, b"")

    def _keep(self, state: bytes, size: int, rank: bytes) -> tuple[dict, int, bytes]:
        found = self.kept.get(state)
        if found is None:
            found = self.kept[state] = ({-1: state}, size, rank)
        return found

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """The merges by definition, always the lowest rank and the leftmost of equals, until so
        many parts are left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > until:
            found = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == 1 << 60:
                break
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if rank not in self.halves:
            token = self.bytes_of[rank]
            self.halves[rank] = None if len(token) == 1 else tuple(
                self.ranks[part] for part in self.merge(token, 2))
        return self.halves[rank]

    def _may_follow(self, first: int, second: int) -> bool:
        """Whether no merge across the border comes before the merges that made the two tokens.

        The tokens are taken apart towards the border, the latest merge first.  At each stage the
        parts that touch exist until the undone merge; they must not merge with each other earlier.
        """
        if first == NO_TOKEN:
            return True
        pair = first << 20 | second
        found = self.pairs.get(pair)
        if found is None:
            found = self.pairs[pair] = self._border_holds(first, second)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        never = 1 << 60
        # The merge after which a part is no longer there; of equals the leftmost merge comes first.
        left_ends, right_ends = (never, 0), (never, 1)
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and left_ends > (joined, 0.5) < right_ends:
                return False
            halves_left, halves_right = self._halves(left), self._halves(right)
            if halves_left is None and halves_right is None:
                return True
            if halves_right is None or halves_left is not None and left > right:
                left_ends, left = (left, 0), halves_left[1]
            else:
                right_ends, right = (right, 1), halves_right[0]

    def _step(self, row: dict, byte: int) -> tuple[dict, int, bytes]:
        live, whole, child, rank_at = [], None, self.child, self.rank_at
        for packed in _unpacked(row[-1]):
            node = child.get((packed >> 20) << 8 | byte)
            if node is None:
                continue
            last = packed & NO_TOKEN
            live.append(node << 20 | last)
            if whole is None:
                rank = rank_at.get(node)
                if rank is not None and self._may_follow(last, rank):
                    whole = rank
        if whole is None:
            raise ValueError("the vocabulary has no token for a byte")
        live.append(whole)
        move = row[byte] = self._keep(
            _packed(live), self.size[whole], whole.to_bytes(4, sys.byteorder))
        return move

    def _settled(self, row: dict, outputs: list[tuple[dict, int, bytes]]) -> int:
        """The position up to which all live hypotheses have the same tokens."""
        back = [len(outputs) - self.depth[packed >> 20] for packed in _unpacked(row[-1])]
        while len(set(back)) > 1:  # the furthest goes back by its last token
            at = back.index(max(back))
            back[at] -= outputs[back[at] - 1][1]
        return back[0]

    def encode(self, data: bytes) -> bytes:
        """The ranks as native 32-bit integers."""
        if len(self.kept) > MAX_STATES or len(self.pairs) > MAX_STATES:
            self._forget()
        row, done = self.start[0], []
        outputs: list[tuple[dict, int, bytes]] = []
        for begin in range(0, len(data), WINDOW):
            for byte in data[begin:begin + WINDOW]:
                move = row.get(byte) or self._step(row, byte)
                row = move[0]
                outputs.append(move)
            if begin + WINDOW < len(data):
                settled = self._settled(row, outputs)
                done += self._tokens(outputs, settled)
                outputs = outputs[settled:]
                if len(self.kept) > MAX_STATES:
                    state, (_, size, rank) = row[-1], outputs[-1]
                    self._forget()
                    row = self._keep(state, size, rank)[0]
        return b"".join(done + self._tokens(outputs, len(outputs)))

    def _tokens(self, outputs: list[tuple[dict, int, bytes]], at: int) -> list[bytes]:
        found = []
        while at > 0:
            _, size, rank = outputs[at - 1]
            found.append(rank)
            at -= size
        found.reverse()
        return found


class TextEncoder:
    """Encodes texts: each match of the pattern separately, matches kept in a bounded table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = BpeTransducer(ranks)
        self.split = regex.compile(pattern).findall
        self.plain_split = re.compile(PLAIN_PATTERN).findall if pattern == KNOWN_PATTERN else None
        # Two generations, so that a full table does not lose the frequent pieces.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.plain_split and not BEYOND_PLAIN(text):
            return self.plain_split(text)
        return self.split(text)

    def encode(self, text: str) -> bytes:
        """The ids as native 32-bit integers."""
        pieces, kept = self.pieces(text), self.kept
        try:
            return b"".join([kept[p] for p in pieces])
        except KeyError:
            if len(kept) > MAX_KEPT:
                self.older, self.kept = kept, {}
                kept = self.kept
            return b"".join([kept.get(p) or self._piece(p) for p in pieces])

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.transducer.encode(piece.encode())
        if len(piece) <= MAX_KEPT_PIECE:
            self.kept[piece] = ids
        return ids


class Utf8Stream:
    """Incremental decoder: gives the characters that are complete, keeps back at most 3 bytes."""

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # a lead byte: it says how long the character is
                size = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
                return back if size > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        keep = self.unfinished(data)
        self.waiting = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class TokenBytes:
    """The bytes of the tokens as one array."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = {rank: token for token, rank in ranks.items()}
        ordered = [tokens.get(rank, b"") for rank in range(max(tokens, default=-1) + 1)]
        self.sizes = np.array([len(t) for t in ordered], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(ordered), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[shift + np.arange(ends[-1])].tobytes()


def decode_stream(chunks: Iterable[np.ndarray], tokens: TokenBytes) -> Iterator[str]:
    """Text of a stream of chunks of ids."""
    stream = Utf8Stream()
    for chunk in chunks:
        yield stream.feed(tokens.join(chunk))
    yield stream.close()


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One per worker process, whatever the number of tasks."""
    return TextEncoder(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(load_ranks(path))


#: A column made of another: source, name, type, and what gives a task its function of Arrow arrays.
Step = tuple[str, str, T.DataType, Callable[[], Callable[[pa.Array], pa.Array]]]


def _append(df: DataFrame, *steps: Step) -> DataFrame:
    """``df`` with the columns of all steps, one after the other, in one Arrow pass."""
    fields = {field.name: field for field in df.schema}
    for _, name, kind, _ in steps:
        fields.pop(name, None)
        fields[name] = T.StructField(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(source, name, make()) for source, name, _, make in steps]
        for batch in slices(batches):
            columns = dict(zip(batch.schema.names, batch.columns))
            for source, name, convert in made:
                columns[name] = convert(columns[source])
            yield pa.RecordBatch.from_arrays([columns[name] for name in fields], list(fields))

    return df.mapInArrow(run, T.StructType(list(fields.values())))


def _encoding(text: str, ids: str, path: str, pattern: str) -> Step:
    def make():
        encoder = text_encoder(path, pattern)

        def convert(texts: pa.Array) -> pa.Array:
            gc.disable()  # its scans of the large tables cost as much as the encoding
            try:
                found = [encoder.encode(x.as_py() or "") for x in texts]
            finally:
                gc.enable()
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            return pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))

        return convert

    return text, ids, T.ArrayType(T.IntegerType(), True), make


def _decoding(ids: str, text: str, path: str) -> Step:
    def make():
        tokens = token_bytes(path)

        def convert(lists: pa.Array) -> pa.Array:
            values = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            return pa.array(["".join(decode_stream(
                (values[at:min(at + DECODE_CHUNK, end)] for at in range(begin, end, DECODE_CHUNK)),
                tokens)) for begin, end in zip(bounds[:-1], bounds[1:])], pa.string())

        return convert

    return ids, text, T.StringType(), make


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the tokens of the whole ``text``; a null or empty text has none.

    The vocabulary file is read by each worker from ``path``.  An existing column named ``ids`` is
    replaced; all others pass.  Rows stay where they are; memory is that of a batch.
    """
    return _append(df, _encoding(text, ids, path, pattern))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, decoded from ``ids``; null ids give an empty text, as no ids do."""
    return _append(df, _decoding(ids, text, path))


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
                      decoded: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, in one pass: one worker a core, nothing written between."""
    return _append(df, _encoding(text, ids, path, pattern), _decoding(ids, decoded, path))
