"""Periodic runs of words: maximal stretches that repeat with one period at least four times.

Maximal pairs are enumerated over an LCP-interval tree.  Two places ``i < j`` whose texts agree for
exactly ``l`` words and whose left words differ are a maximal pair; words ``i .. j + l - 1`` then have
period ``q = j - i`` and no neighbour extends them, so a pair with ``l >= 3 q`` and ``l + q >= 6`` is a
run as it stands.  The smallest such ``q`` of a stretch is its smallest period.

1. Regions.  In a run of ``l + q`` words, each of the first ``l - 4`` places has the same five words
   again within ``q <= l / 3``.  Stretches of places without such a recurrence hold no run; what is left
   is cut out with the words that decide whether its runs go on.
2. Suffix order of all regions of a batch by prefix doubling; agreeing lengths from the ranks kept.
3. The tree is walked bottom up.  An interval keeps its places in text order, each with the class of
   its left word.  The smaller child is put into the larger one, and a place meets only its neighbours
   there: between places closer than a third of ``l`` lie only places of the same class, so pairs
   within a class are passed over without being listed, and a run's own pair is always one of
   neighbours.  Every place moves O(log n) times.

All of it is arithmetic on one document's words; documents are Spark's rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilscan.llm.common import slices

#: A run has at least so many periods and words.
MIN_PERIODS, MIN_WORDS = 4, 6
#: Words that the texts at both places of any run's pair share: ``l >= max(3 q, 6 - q)``.
SEED = 5
#: Sorted places are kept in pieces of at most so many.
PIECE = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """Ascending numbers, in pieces, so that putting one in stays cheap in very long lists."""

    __slots__ = ("pieces", "lows", "size")

    def __init__(self, first: int):
        self.pieces, self.lows, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def put(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; its neighbours, -1 where there is none."""
        k = max(bisect_left(self.lows, x) - 1, 0)
        piece = self.pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else -1
        if at < len(piece):
            after = piece[at]
        else:
            after = self.pieces[k + 1][0] if k + 1 < len(self.pieces) else -1
        piece.insert(at, x)
        self.size += 1
        if not at:
            self.lows[k] = x
        if len(piece) > PIECE:
            half = len(piece) // 2
            self.pieces[k:k + 1] = [piece[:half], piece[half:]]
            self.lows[k:k + 1] = [piece[0], piece[half]]
        return before, after


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``words`` in order, and the number of words that each shares with the one before.

    No two suffixes may be equal as far as they go: the last word occurs once.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank.astype(np.int32)], 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or 2 * step >= n:
            break
        ranks.append(rank.astype(np.int32))
        step *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for level in range(len(ranks) - 1, -1, -1):
        at_a, at_b = a + shared[1:], b + shared[1:]
        inside = (at_a < n) & (at_b < n)
        equal = inside & (ranks[level][np.minimum(at_a, n - 1)] == ranks[level][np.minimum(at_b, n - 1)])
        shared[1:] += equal.astype(np.int64) << level
    return order, shared


def maximal_pairs(order: np.ndarray, shared: np.ndarray, left: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(i, q, l)`` of the maximal pairs ``i, i + q`` of neighbours with ``l >= 3 q`` and ``l + q >= 6``.

    ``left`` is the class of each place: its left word.
    """
    intervals: list[tuple[int, Places]] = []  # open ones: words shared, places; a leaf shares all
    for place, depth in zip(order.tolist(), shared.tolist()):
        while intervals and intervals[-1][0] > depth:
            length, child = intervals.pop()
            if not intervals or intervals[-1][0] < depth:
                if depth >= SEED:
                    intervals.append((depth, child))
                    break
                if not intervals:
                    break
            length, parent = intervals.pop()
            if parent.size < child.size:
                parent, child = child, parent
            reach = length // (MIN_PERIODS - 1)
            last = -1
            for x in child:
                before, after = parent.put(x)
                # The one put in before shares more with x: the pair was met deeper in the tree.
                if before != last and before >= 0 and x - before <= reach and left[before] != left[x] and (
                        x - before + length >= MIN_WORDS):
                    yield before, x - before, length
                if after >= 0 and after - x <= reach and left[after] != left[x] and (
                        after - x + length >= MIN_WORDS):
                    yield x, after - x, length
                last = x
            intervals.append((length, parent))
        intervals.append((len(order), Places(place)))


def _near_recurrence(grams: np.ndarray) -> np.ndarray:
    """How far on the same gram comes next; a very large number where it does not."""
    far = np.full(len(grams), np.iinfo(np.int64).max)
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    far[order[again]] = order[again + 1] - order[again]
    return far


def regions(words: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """Stretches ``[from, to)`` outside which no run lies; each holds a run's words and one more on
    the right, unless its document ends."""
    count = len(words) - SEED + 1
    if count <= 0:
        return []
    grams = document[:count].astype(np.uint64)
    for i in range(SEED):
        grams = (grams + words[i:i + count].astype(np.uint64) + np.uint64(1)) * _MIX
        grams ^= grams >> np.uint64(29)
    far = _near_recurrence(grams)
    far[document[:count] != document[SEED - 1:]] = np.iinfo(np.int64).max  # five words of two documents
    limit = np.full(count, count, np.int64)
    while True:
        close = far <= limit
        edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]])))
        starts, ends = edges[::2], edges[1::2]
        # A run's first l - 4 places lie in one stretch.
        longest = (ends - starts + SEED - 1) // (MIN_PERIODS - 1)
        following = np.zeros(count, np.int64)
        following[close] = np.repeat(longest, ends - starts)
        if (far[close] <= following[close]).all():
            break
        limit = following
    last = np.searchsorted(document, document[starts], side="right")
    return list(zip(starts.tolist(), np.minimum(ends + SEED + longest, last).tolist()))


def runs_of(words: np.ndarray, document: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """``(start, length, period)`` by document, ordered by start, then period.

    ``words`` are numbers of words, those of a document together and ``document`` ascending; a start
    counts from the document's first word.
    """
    cut = regions(words, document)
    if not cut:
        return {}
    text, where, region, ends = [], [], [], []
    mark = int(words.max()) + 1
    for k, (start, end) in enumerate(cut):
        text += [words[start:end], [mark + k]]  # the mark occurs once: nothing agrees beyond it
        where += [np.arange(start, end + 1)]
        region += [np.full(end - start + 1, k)]
        closed = end == len(words) or document[end] != document[start]
        ends.append(np.full(end - start + 1, -1 if closed else end))
    text, where, region, ends = (np.concatenate(x) for x in (text, where, region, ends))
    at = np.minimum(where, len(words) - 1)
    begins = (at == 0) | (document[at] != document[at - 1])
    left = np.where(begins, -1, words[at - 1]).tolist()
    order, shared = suffix_order(text)
    smallest: dict[tuple[int, int], int] = {}
    for i, period, length in maximal_pairs(order, shared, left):
        start = int(where[i])
        if region[i] != region[i + period] or start + period + length == ends[i]:
            continue  # of two regions, or it meets the region's end, which no run of the region does
        key = (start, period + length)
        smallest[key] = min(period, smallest.get(key, period))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for (start, length), period in smallest.items():
        own = int(document[start])
        found.setdefault(own, []).append((start, length, period))
    for own, runs in found.items():
        first = int(np.searchsorted(document, own))
        found[own] = sorted(((s - first, n, q) for s, n, q in runs), key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, keep in zip(words, kept.tolist()) if keep])


#: Words of a batch whose documents are ordered together.
TOGETHER = 1 << 17


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of ``start, length, period`` in words, by start, then
    period) and ``collapsed``, the text without what its runs repeat.

    Words are what lies between ASCII white space of the whole ``text``.  A run is a stretch with a
    smallest period that no neighbouring word extends, of at least four periods and six words.  Null,
    empty and blank texts have no words, no runs and an empty ``collapsed``.  Rows are judged each by
    itself, so repeated rows and null or repeated ids are kept as they are; columns of the names of
    results are replaced.  An empty table gives no rows.
    """
    names = ["n_words", "runs", "collapsed"]
    docs = docs.drop(*names)

    def flush(texts: list[list[bytes]]) -> list:
        numbers: dict[bytes, int] = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64)
        return runs_of(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [(t.as_py() or "").encode().split() for t in batch.column("text")]
            every: list[list[tuple[int, int, int]]] = []
            start = total = 0
            for k, text in enumerate(texts):
                total += len(text)
                if total >= TOGETHER or k + 1 == len(texts):
                    part = texts[start:k + 1]
                    found = flush(part)
                    every += [found.get(i, []) for i in range(len(part))]
                    start, total = k + 1, 0
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in every])]), pa.int32())
            flat = np.array([x for r in every for x in r], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                [pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(t) for t in texts], pa.int64()), runs,
                 pa.array([collapsed(t, r) for t, r in zip(texts, every)], pa.binary()).cast(pa.string())],
                [*batch.schema.names, *names])

    added = StructType.fromDDL(
        "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return docs.mapInArrow(run, StructType(docs.schema.fields + added.fields))


def with_repeats(docs: DataFrame) -> DataFrame:
    """A tenth of the documents with a made repetition: where ten divides the CRC of the number, words
    from one place on repeat what follows it, place and period being given by the CRC.

    Texts of other documents, without words or without a number stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeated(w):
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    # Within an array of one, the words are found once and not for each of them.
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")))
