"""Hierarchical residual packing of documents into fixed-size token sequences.

Round 0 deals pieces over groups of bounded size and packs each group best-fit, longest first.  Bins
that are nearly full are done.  The others go up the tree as single items: fewer groups, best fit
again, until one group is left or nothing merges any more.  A piece's place is its offset in its
first bin plus that bin's offset in the bin it went into, and so on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import materialize, slices

#: Kept words and kept pieces, in each of two generations.
MAX_KEPT = 250_000
#: Separators of words that str.split knows and the vocabulary's normaliser does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case is one letter of the same range.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ȹȻ-Ƚȿ-ʯ"
#: Words of common Latin characters, which the normaliser only lower-cases, and their pieces.
PLAIN = re.compile(f"[!-~¡-©«-±´¶·¸»¿{_LATIN}‘’“”–—…]{{1,64}}").fullmatch
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^0-9{_LATIN}]+").findall
#: At most so many items in one group.
GROUP_ITEMS = 50_000
MAX_ROUNDS = 30


class WordEncoder:
    """Ids of a vocabulary whose tokens never span white space, as little-endian 32-bit bytes.

    Words and the pieces they fall into are encoded once and kept in bounded tables.  Words of common
    Latin characters are split here and their pieces merged by the tokenizer's model; words with any
    other character go through the whole tokenizer.  With ``added_tokens`` so do whole texts that
    hold one of the vocabulary's added tokens, which may lie within words or span them; without, such
    strings are text like any other.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = self.tokenizer.get_added_tokens_decoder().values() if added_tokens else []
        if any(t.normalized for t in added):
            raise ValueError("added tokens that match normalised text are not supported")
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")
        self.model = self.tokenizer.model
        # The stand-in characters of bytes, in the order of the vocabulary's byte level.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self.signs = {b: 256 + i for i, b in enumerate(others)}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _fresh(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _merged(self, piece: str) -> bytes:
        signs = piece.encode().decode("latin-1").translate(self.signs)
        return np.array([t.id for t in self.model.tokenize(signs)], "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces[piece] = self.older_pieces.get(piece) or self._merged(piece)
        return found

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if PLAIN(word):
                pieces = self.pieces
                found = b"".join([pieces.get(p) or self._piece(p) for p in PIECES(word.lower())])
            else:
                found = self._fresh([word])[0]
        if len(word) <= 64:
            self.kept[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text) or self.added.search(text):
            return self._fresh([text])[0]
        words, kept = text.split(), self.kept
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            if len(kept) > MAX_KEPT:
                self.older, self.kept = kept, {}
                kept = self.kept
            if len(self.pieces) > MAX_KEPT:
                self.older_pieces, self.pieces = self.pieces, {}
            return b"".join([kept.get(w) or self._word(w) for w in words])

    def forget(self) -> None:
        """Let go of kept words and pieces; the vocabulary stays."""
        self.kept, self.older, self.pieces, self.older_pieces = {}, {}, {}, {}


@lru_cache(maxsize=2)
def _encoder(path: str, added_tokens: bool) -> WordEncoder:
    return WordEncoder(path, added_tokens)


def cut_pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1,
               added_tokens: bool = False) -> DataFrame:
    """Pieces of every whole document: ``doc_id, piece, start, length, ids`` (binary, little-endian
    unsigned 32-bit), the document's ids being its tokens and ``end_id``.  With ``added_tokens`` the
    vocabulary's added tokens are matched in texts, as the tokenizer does by default.

    Null and empty texts have ``end_id`` alone.  Only documents longer than ``size`` are cut.
    Repeated rows give repeated pieces, a null ``doc_id`` stays null; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path, added_tokens), np.array([end_id], "<u4").tobytes()
        step = 4 * size
        try:
            for batch in slices(batches):
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encoder.encode(text.as_py() or "") + end
                    rows += [(doc_id, at // step, at // 4, min(step, len(ids) - at) // 4,
                              ids[at:at + step]) for at in range(0, len(ids), step)]
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "piece", "start", "length", "ids"])
        finally:
            encoder.forget()  # the worker lives on, and other steps need its memory

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, longest first, into the fullest bin that has room; bins' fill.

    Room is looked up in a bit set of the rooms there are, so an item costs the same however many
    bins are open.
    """
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for item in np.argsort(-lengths, kind="stable"):
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_ = size, len(fill)
            fill.append(0)
        bins[item], offsets[item] = bin_, fill[bin_]
        fill[bin_] += length
        by_room[room - length].append(bin_)
        rooms |= 1 << (room - length)
    return bins, offsets, fill


def _round(items: DataFrame, number: int, groups: int, size: int, salt: list[str]) -> DataFrame:
    """``items`` (with ``length``) with ``bin``, ``offset`` and ``fill``, the bin's tokens."""
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(salt, kind="stable", ignore_index=True)
        bins, offsets, fill = best_fit(frame["length"].to_numpy(), size)
        base = number << 56 | int(frame["_group"].iloc[0]) << 24
        return frame.drop(columns="_group").assign(
            bin=base + bins, offset=offsets, fill=np.array(fill, np.int64)[bins])

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(*salt), F.lit(groups)).cast("long"))
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", bin long, offset long, fill long"
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack(pieces: DataFrame, size: int = 4096, nearly_full: float = 0.995,
         group_items: int = GROUP_ITEMS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, gapless from 0 within a sequence.

    ``pieces`` needs ``doc_id``, ``piece`` and ``length`` (1 to ``size``); other columns pass,
    except ones with the names of the results.  A group holds about ``group_items`` items, so a
    task's memory does not grow with the input; equal pieces are dealt by their number and start,
    and a document id that very many rows share is spread by a row's own columns.  An empty table
    gives an empty table.
    """
    taken = {"sequence_id", "offset", "bin", "fill", "_group", "_deal"}
    pieces = pieces.select(*(c for c in pieces.columns if c not in taken))
    own = [F.col(c) for c in pieces.columns]
    # Repeated rows are told apart by where they lie; any deal gives a right result.
    pieces_dealt = materialize(pieces.withColumn(
        "_deal", F.xxhash64(*own, F.monotonically_increasing_id())), "pieces")
    groups = max(1, math.ceil(pieces_dealt.count() / group_items))
    packed = materialize(_round(pieces_dealt, 0, groups, size, ["_deal"]), "packed-0")
    least = math.ceil(nearly_full * size)
    # Where bins went: bin -> top, shift.
    open_bins = packed.where(F.col("fill") < least).select(
        F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
    moves: list[DataFrame] = []
    left, number = open_bins.count(), 0
    while left > 1 and number < MAX_ROUNDS:
        number += 1
        groups = max(1, math.ceil(left / group_items))
        merged = materialize(_round(open_bins, number, groups, size, ["item"]), f"packed-{number}")
        moves.append(merged.select(F.col("item").alias("top"), F.col("bin").alias("_bin"),
                                   F.col("offset").alias("_shift")))
        open_bins = merged.where(F.col("fill") < least).select(
            F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        before, left = left, open_bins.count()
        if groups == 1 or left >= before:
            break
    placed = packed.drop("fill", "_deal").withColumnRenamed("bin", "top")
    for move in moves:
        placed = placed.join(move, "top", "left").select(
            *pieces.columns, F.coalesce("_bin", "top").alias("top"),
            (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))
    return placed.select(*pieces.columns, F.col("top").alias("sequence_id"), "offset")
