"""Spelling variants: words that differ by one edited character, by permuterm rotations.

Every word ends in a terminator and is rotated to each of its places.  A word with its character
``i`` left out reads, from that place on, ``after TERMINATOR before``: the rotation that starts behind
the character, less its last place, which is the character itself.  So

* words that differ by a replacement share that prefix and go on with different characters;
* a word that lacks the character has the whole prefix as a rotation of its own.

Rotations are dealt by prefix and sorted, so a prefix range is scanned in one go.  A range holds at
most one word for each character of the alphabet and one word without it, however frequent its
words are: no range grows with the corpus.  The scan emits for each member how many others it has and
the best of them, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import materialize

#: A code point that no text holds.
TERMINATOR = "\U0010ffff"
#: Longer prefixes are compared by digest.
LONG = 64
#: A form has at least ten times the word's count and counts are below 2 ** 63, so a chain has at most
#: 19 forms; following doubles its reach in each round.
FOLLOW_ROUNDS = 5


def rotations(words: DataFrame) -> DataFrame:
    """``key, edited, first, id, n`` of ``words`` (``word``, ``n``): a row for each whole rotation (no
    ``edited``) and one for each rotation less the edited character.

    ``first`` is false where the character before is the same: leaving out either gives one word.
    Prefixes of over ``LONG`` characters are known by their 128-bit digest, and their word by its own
    (``id``), so that the rows of a long word do not grow with the square of its length.
    """
    word, size = F.col("word"), F.length("word")

    def cut(start: Column | int, length: Column | int) -> Column:
        return F.substring(word, start if isinstance(start, Column) else F.lit(start), length)

    def key(length: Column, after: Column, before: Column) -> Column:
        text = F.concat(after, F.lit(TERMINATOR), before)
        return F.when(length <= LONG, text).otherwise(F.md5(text))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        key(size + 1, cut(i + 1, size), cut(1, i)).alias("key"), F.lit(None).cast("string").alias("edited"),
        F.lit(True).alias("first"), F.when(size + 1 > LONG, F.col("id")).alias("id")))
    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        key(size, cut(i + 1, size), cut(1, i - 1)).alias("key"), cut(i, F.lit(1)).alias("edited"),
        ((i == 1) | (cut(i, F.lit(1)) != cut(i - 1, F.lit(1)))).alias("first"),
        F.when(size > LONG, F.col("id")).alias("id")))
    usable = words.where((size > 0) & ~F.contains(word, F.lit(TERMINATOR))).withColumn(
        "id", F.when(size >= LONG, F.md5("word")))
    return usable.select("n", F.explode(F.concat(whole, less)).alias("r")).select("r.*", "n")


def _members(keys: list, edited: list, first: list, ids: list, counts: list) -> Iterator[tuple]:
    """``(word, others, best count, best word, digests)`` for each member of one prefix range that has
    others.  Words known by digest get a row for each of several best ones, the others counted once."""
    skipping, whole = [], None
    digests = ids[0] is not None
    for key, character, alone, own, n in zip(keys, edited, first, ids, counts):
        if not digests:
            after, before = key.split(TERMINATOR)
            own = before + (character or "") + after
        if character is None:
            whole = (-n, own)
        else:
            skipping.append(((-n, own), alone))
    if not skipping:
        return
    ordered = sorted(place for place, _ in skipping)

    def best(others: list) -> Iterator[tuple]:
        if digests:
            return (p for p in others if p[0] == others[0][0])
        return iter(others[:1])

    for place, alone in skipping:
        # Two are enough to leave the own one out, unless all that are equal count.
        others = [p for p in (ordered if digests else ordered[:2]) if p != place]
        number = len(ordered) - 1
        if whole is not None and alone:
            others, number = sorted([whole, *others]), number + 1
        for n, other in best(others):
            yield place[1], number, -n, other, digests
            number = 0
    longer = sorted(place for place, alone in skipping if alone)
    if whole is not None:
        number = len(longer)
        for n, other in best(longer):
            yield whole[1], number, -n, other, digests
            number = 0


FOUND = "word string, others long, best_n long, best string, digests boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of rotations sorted by ``key``; the last range of a batch waits for the next."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        keys = rows.column("key").combine_chunks()
        new = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
        starts = np.concatenate([[0], new]).astype(np.int64)
        ready = rows.slice(0, starts[-1])
        rest = rows.slice(starts[-1]).combine_chunks().to_batches()[0]
        yield from _ranges(ready, starts)
    if rest is not None:
        yield from _ranges(pa.Table.from_batches([rest]), np.array([0, rest.num_rows]))


def _ranges(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    shared = np.diff(bounds) > 1
    starts, ends = bounds[:-1][shared], bounds[1:][shared]
    if not len(starts):
        return
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    few = rows.take(pa.array(at))
    columns = [few.column(c).to_pylist() for c in ("key", "edited", "first", "id", "n")]
    out, place = [], 0
    for size in sizes.tolist():
        out += _members(*(c[place:place + size] for c in columns))
        place += size
    if out:
        word, others, best_n, best, digests = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(word), pa.array(others, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best),
             pa.array(digests)], ["word", "others", "best_n", "best", "digests"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: of each word that has near ones their number, and the one of
    them with the largest count (ties: the smallest word in code-point order) with its count.

    ``words`` has distinct ``word`` and their count ``n``.  Near words differ by exactly one inserted,
    deleted or replaced code point.  Null and empty words, and words that hold U+10FFFF, take no part.
    """
    dealt = rotations(words).repartition("key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_scan, FOUND), "near")
    long = words.where(F.length("word") >= LONG).select("word", F.md5("word").alias("id"))
    side = lambda name: long.select(F.col("word").alias(f"{name}_text"), F.col("id").alias(name))
    by_digest = found.where("digests").join(side("word"), "word").join(side("best"), "best").select(
        F.col("word_text").alias("word"), "others", "best_n", F.col("best_text").alias("best"))
    found = found.where("not digests").drop("digests").unionByName(by_digest)
    return found.groupBy("word").agg(
        F.sum("others").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("near"))).alias("top")).select(
        "word", "n_near", (-F.col("top.order")).alias("near_n"), F.col("top.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that forms lead to from each word that has one."""
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(FOLLOW_ROUNDS):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        reach = materialize(reach.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.isnotnull("onward").alias("moved")), "roots")
        if reach.where("moved").isEmpty():
            break
    return reach.select("word", "root")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each row of ``words`` (distinct ``word``, ``n``: long).

    A word's form is its near word of largest count if that is larger and at least ``ratio`` times its
    own; its root is the last word that forms lead to, itself if it has none.  ``ratio`` is at least 10, as
    chains of forms are followed as far as counts can grow.  Other columns are not read.  A null word
    has no near words, a count of null is none; repeated words have to be summed before.  An empty
    table gives no rows.
    """
    if ratio < 10:
        raise ValueError("ratio is at least 10")
    words = materialize(words.select("word", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n")), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = (F.col("near_n") >= ratio * F.col("n")) & (F.col("near_n") > F.col("n"))
    formed = materialize(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    return formed.join(_roots(formed.where("form is not null")), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[A-Z]"), F.translate(text, upper, upper.lower())).otherwise(text)


def count_words(docs: DataFrame, edit_share: int = 0, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``word, n``: runs of Latin letters of whole texts, A-Z lower-cased, counted before the shuffle.

    With ``edit_share`` one in so many pairs of document and word is misspelt: where it divides the
    CRC of ``doc_id:word``, the code point with the CRC's remainder by the length is left out.  Null
    and empty texts have no words; a null ``doc_id`` counts as an empty one.
    """
    run = f"[A-Za-zÀ-ÿ]{{{min_length},}}"
    found = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("run"))
    found = found.select("id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run")
    if edit_share:
        found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        word = F.when(F.col("h") % edit_share == 0, F.concat(
            F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    return found.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)
