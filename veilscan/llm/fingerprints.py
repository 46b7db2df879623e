"""Document fingerprints: a quartile digest of hashed byte triplets.

Every three bytes in a row are hashed to one of a fixed number of buckets and counted.  A bucket's
code says in which quartile of all buckets its count lies; the digest is these two-bit codes and a
logarithmic length, in hexadecimal.  Two digests are compared by the differences of their codes, a
score bounded by the number of buckets; likeness is 1 less its share of the largest difference.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import slices

N_BUCKETS = 1024
#: What a step of the logarithmic length counts as, in steps of a bucket's code, and at most.
LENGTH_WEIGHT, LENGTH_MOST = 4, 64
_BLOCK = 1 << 20


def bucket_counts(data: bytes, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Counts of the hashed triplets of whole data, block by block."""
    counts = np.zeros(n_buckets, np.int64)
    shift = np.uint32(32 - (n_buckets.bit_length() - 1))
    for begin in range(0, max(0, len(data) - 2), _BLOCK):
        block = np.frombuffer(data[begin:begin + _BLOCK + 2], np.uint8).astype(np.uint32)
        hashed = (block[:-2] << np.uint32(16) | block[1:-1] << np.uint32(8) | block[2:])
        hashed *= np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x85EBCA77)
        counts += np.bincount(hashed >> shift, minlength=n_buckets)
    return counts


def digest(data: bytes, n_buckets: int = N_BUCKETS) -> bytes:
    """Length byte and packed codes.  Data under three bytes has all codes 0."""
    counts = bucket_counts(data, n_buckets)
    ordered = np.sort(counts)
    quartiles = ordered[[n_buckets // 4 - 1, n_buckets // 2 - 1, 3 * n_buckets // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, round(math.log(len(data) + 1, 1.12)))
    return bytes([length]) + packed.tobytes()


def _codes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), -1)
    body = table[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return table[:, 0].astype(np.int64), body.reshape(len(digests), -1).astype(np.int8)


def likeness(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """0 to 1 for each pair of digests; 1 for equal digests."""
    if not first:
        return np.zeros(0)
    (length_a, codes_a), (length_b, codes_b) = _codes(first), _codes(second)
    codes = np.abs(codes_a - codes_b).sum(1, dtype=np.int64)
    lengths = np.minimum(LENGTH_WEIGHT * np.maximum(np.abs(length_a - length_b) - 2, 0), LENGTH_MOST)
    return 1 - (codes + lengths) / (3 * codes_a.shape[1] + LENGTH_MOST)


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the hexadecimal digest of the whole ``text`` (null: empty); ``name`` is replaced."""
    kept = [c for c in docs.columns if c != name]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [digest((x.as_py() or "").encode()).hex() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.string())], [*kept, name])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)
    return docs.select(*kept).mapInArrow(run, f"{fields}, `{name}` string")


#: Stands for a null doc_id in the order of documents: before all others.
_FIRST = -(1 << 63)


def _deal_in_order(docs: DataFrame, n_parts: int) -> DataFrame:
    """``doc_id, key, text, part, follows`` sorted by key in parts of increasing keys, at most
    ``n_parts``; each part also gets, marked ``follows``, the first document after it (after the
    last: the first of all).

    Only ids are read to find the bounds of the parts; the text is moved once.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "key", F.coalesce("doc_id", F.lit(_FIRST)))
    shares = [i / n_parts for i in range(1, n_parts)]
    bounds = np.array(sorted(set(keyed.agg(
        F.percentile_approx("key", shares or [0.5], 10_000)).first()[0] or ())), np.int64)
    if n_parts == 1:
        bounds = bounds[:0]

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            parts = np.searchsorted(bounds, keys, "right")
            for part in np.unique(parts):
                least = int(keys[parts == part].min())
                found[int(part)] = min(found.get(int(part), least), least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
            ["part", "key"])

    # One row per part: no more than n_parts reach the driver.
    firsts = sorted((r["part"], r["key"]) for r in keyed.select("key").mapInArrow(
        first_keys, "part int, key long").groupBy("part").agg(F.min("key").alias("key")).collect())
    parts_before = [part for part, _ in firsts]
    goes_to = {key: parts_before[i - 1] for i, (_, key) in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.array(sorted(goes_to), np.int64)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            parts = np.searchsorted(bounds, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(parts), pa.array(np.zeros(len(keys), bool))],
                ["doc_id", "text", "key", "part", "follows"])
            again = np.flatnonzero(np.isin(keys, heads))
            if len(again):
                taken = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array([goes_to[int(k)] for k in keys[again]], pa.int32()),
                     pa.array(np.ones(len(again), bool))],
                    ["doc_id", "text", "key", "part", "follows"])

    dealt = keyed.mapInArrow(deal, "doc_id long, text string, key long, part int, follows boolean")
    return dealt.repartitionById(n_parts, "part").sortWithinPartitions(
        "part", "follows", "key", "text")


def compare_with_next(docs: DataFrame, n_parts: int | None = None,
                      n_buckets: int = N_BUCKETS) -> DataFrame:
    """Each document's digest against that of its edited text and that of the next document.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as
    many of the next document, by ascending ``doc_id`` (after the last: the first).  Returns
    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.

    A null text counts as empty, a null ``doc_id`` comes before all others, documents of one
    ``doc_id`` follow each other by text.  A single document is its own next one; an empty table
    gives an empty table.  Other columns are not read.  Documents stream through a task.
    """
    n_parts = n_parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited",
             "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the document that waits for its next one: (part, id, text, digest)
        for batch in slices(batches):
            rows, own, edited, following = [], [], [], []
            for doc_id, text, part, follows in zip(
                    batch.column("doc_id").to_pylist(), batch.column("text"),
                    batch.column("part").to_pylist(), batch.column("follows").to_pylist()):
                if follows and (before is None or before[0] != part):
                    continue  # more documents of the following id
                text = text.as_py()
                made = digest(text.encode(), n_buckets)
                if before is not None and before[0] == part:
                    _, last_id, last, last_digest = before
                    kept = len(last) - len(last) // 4
                    changed = last[:kept] + text[:len(last) // 4]
                    rows.append((last_id, len(last), changed))
                    own.append(last_digest)
                    edited.append(digest(changed.encode(), n_buckets))
                    following.append(made)
                before = None if follows else (part, doc_id, text, made)
            if rows:
                columns = [*map(list, zip(*rows)), [d.hex() for d in own], [d.hex() for d in edited],
                           likeness(own, edited), likeness(own, following)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return _deal_in_order(docs, n_parts).mapInArrow(
        run, "doc_id long, n_chars long, edited string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
