"""Jaccard join of documents on their word shingles, as classes of linked documents.

1. Equal sets are one node, known by the 64-bit digest of its set, from the start.
2. A node enters the tiles of its prefix: the shingles that any partner of enough similarity has to
   share with it in part, in one order for all, so that frequent shingles come last.  The frequent
   ones are found over all documents; whatever their list, the candidates are complete.
3. Tiles with the same members are one tile.  In a tile every node is first compared with the hub,
   the node that lies in most tiles: of near copies that is most often their original.
4. Nodes of different classes so far are compared within size-banded tiles, split into blocks when
   large, without making rows of pairs: signatures of hashed bits are compared, and the count of
   differing bits bounds the overlap from above.  First a tile gives only as many pairs as would join
   its classes, then, once these are verified, all that are left between different classes.
5. Pairs that stay are verified by exact intersection of the sorted arrays.  Only their texts are
   read again.
6. Links make components.

A link between nodes of one component may stay unstated, none between different ones does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import forget, materialize, slices
from veilscan.llm.components import components
from veilscan.llm.shingles import Shingler, mixed

#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles in at least one of so many documents of a task are candidates for frequent ones, and the
#: list of frequent ones has at most so many (8 bytes each are sent to every worker).
FREQUENT_SHARE, MAX_FREQUENT = 1000, 1 << 18
#: A task counts shingles in portions of so many.
PORTION = 1 << 21
#: Nodes in a block of a tile.
BLOCK = 1024
BITS_PER_SHINGLE = 2
#: Nodes of a frequent shingle in a part; entries of a key that are looked at together; partners of a
#: node in a part.
PART, LARGE, CROWD = 1 << 13, 1 << 20, 1 << 10


def required(size: np.ndarray | int):
    """Shingles of a set of this size that any partner has to share."""
    return (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR


def similar_sizes(a: Column, b: Column) -> Column:
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def signature(shingles: np.ndarray) -> bytes:
    """Parities of hashed bits; the width is a power of two, so a wider one folds to a narrower."""
    width = 64
    while width < BITS_PER_SHINGLE * len(shingles):
        width *= 2
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(signature: np.ndarray, width: int) -> np.ndarray:
    """Signature (64-bit words, along the first axis) folded to ``width`` words."""
    while len(signature) > width:
        half = len(signature) // 2
        signature = signature[:half] ^ signature[half:]
    return signature


def may_link(size_a, size_b, different):
    """Whether sets that differ in at least ``different`` shingles can be similar enough.

    Intersection and union follow from the sizes and the number of differing shingles.
    """
    total = size_a + size_b
    return 2 * NUMERATOR * (total + different) <= 2 * DENOMINATOR * (total - different)


def text_key(text: Column) -> Column:
    """Tells rows that share a number, or have none, apart by their text."""
    return F.xxhash64(text)


def _digest(shingles: np.ndarray) -> int:
    return np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes()), ">i8")[0]


def _sets(batches, shingler) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches):
        yield batch, [shingler(x.as_py() or "") for x in batch.column("text")]


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (``doc_id, text_key, size, node, bits``), and rows (``shingle, count``)
    for what is frequent in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, n_docs = Shingler(size), 0
        waiting: list[np.ndarray] = []
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def count(keys, counts):
            fresh, n = np.unique(np.concatenate(waiting), return_counts=True)
            fresh, n = fresh[n > 1], n[n > 1]  # once in a portion is not frequent
            waiting.clear()
            merged, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            return merged, np.bincount(at, np.concatenate([counts, n]), len(merged)).astype(np.int64)

        for batch, sets in _sets(batches, shingler):
            n_docs += len(sets)
            waiting += sets
            if sum(map(len, waiting)) > PORTION:
                keys, counts = count(keys, counts)
            filled = [len(s) > 0 for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([_digest(s) if f else None for s, f in zip(sets, filled)], pa.int64()),
                 pa.array([signature(s) if f else None for s, f in zip(sets, filled)], pa.binary()),
                 none, none], names)
        if waiting:
            keys, counts = count(keys, counts)
        often = counts * FREQUENT_SHARE >= max(n_docs, 3 * FREQUENT_SHARE)
        keys, counts = keys[often], counts[often]
        none = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(len(keys), pa.int32()), none, pa.nulls(len(keys), pa.binary()),
             pa.array(keys.view(np.int64)), pa.array(counts)], names)

    names = ["doc_id", "text_key", "size", "node", "bits", "shingle", "count"]
    return docs.withColumn("text_key", text_key(F.col("text"))).mapInArrow(
        run, "doc_id long, text_key long, size int, node long, bits binary, shingle long, count long")


def _entries(docs: DataFrame, size: int, frequent) -> DataFrame:
    """``key, part, node`` for every shingle of every node's prefix; once in a task.

    ``part`` deals the nodes of a very frequent shingle out, ``PART`` to each; it is -1 for others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank, parts = frequent.value  # ascending shingles, their places by frequency, their parts
        shingler, done = Shingler(size), set()
        for _, sets in _sets(batches, shingler):
            keys, dealt, nodes = [], [], []
            for shingles in sets:
                node = _digest(shingles)
                if not len(shingles) or node in done:
                    continue
                done.add(node)
                prefix = len(shingles) - required(len(shingles)) + 1
                part = np.full(prefix, -1, np.int64)
                chosen = shingles[:prefix]
                if len(often):
                    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
                    listed = often[at] == shingles
                    first = np.argsort(np.where(listed, rank[at], 0), kind="stable")[:prefix]
                    chosen, of = shingles[first], np.where(listed[first], parts[at[first]], 1)
                    part = np.where(of > 1, node % of, -1)
                keys.append(chosen)
                dealt.append(part)
                nodes.append(np.full(prefix, node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(dealt)),
                     pa.array(np.concatenate(nodes))], ["key", "part", "node"])

    return docs.mapInArrow(run, "key long, part long, node long")


def _members_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tile, n, node`` of entries sorted by ``part, key, node``, for keys that two nodes share.

    A key's tile is a digest of its members, so that keys with the same members give the same rows.
    Where a key is dealt out, or is too large to be looked at as a whole, its tile is the key itself
    and ``n`` is null.
    """
    none = np.zeros(0, np.int64)

    def rows(tile, n, node):
        return pa.RecordBatch.from_arrays(
            [pa.array(tile), pa.array(n, mask=n < 0), pa.array(node)], ["tile", "n", "node"])

    def groups(key, node):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        mix = mixed(node.view(np.uint64))
        tile = mixed(np.bitwise_xor.reduceat(mix, starts)) + np.add.reduceat(mix * mix, starts)
        kept = np.repeat(sizes > 1, sizes)
        return rows(np.repeat(tile.view(np.int64), sizes)[kept], np.repeat(sizes, sizes)[kept], node[kept])

    rest, large = (none, none), None
    for batch in batches:
        key, part, node = (batch.column(i).to_numpy() for i in range(3))
        whole = part >= 0
        if whole.any():
            yield rows(key[whole], np.full(whole.sum(), -1), node[whole])
            key, node = key[~whole], node[~whole]
        key, node = np.concatenate([rest[0], key]), np.concatenate([rest[1], node])
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        if large is not None and len(key):
            more = int(np.searchsorted(key, large, side="right"))
            yield rows(key[:more], np.full(more, -1), node[:more])
            key, node = key[more:], node[more:]
            large = None if len(key) else large
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield groups(key[:last], node[:last])
        rest = key[last:], node[last:]
        if len(rest[0]) > LARGE:
            large = int(rest[0][0])
            yield rows(rest[0], np.full(len(rest[0]), -1), rest[1])
            rest = none, none
    if len(rest[0]):
        yield groups(*rest)


def _tiles(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, n, node, size``: the members of each tile, with its number of members and their sizes."""
    found = materialize(
        entries.repartition("key", "part").sortWithinPartitions("part", "key", "node").mapInArrow(
            _members_of_keys, "tile long, n long, node long").dropDuplicates(["tile", "node"]), "members")
    counted = found.where("n is null").groupBy("tile").agg(F.count("*").alias("counted"))
    tiles = materialize(
        found.join(counted, "tile", "left").join(nodes.select("node", "size"), "node").select(
            F.col("tile").alias("key"), F.coalesce("n", "counted").alias("n"), "node", "size"), "tiles")
    forget(found)
    return tiles


def _bits_differ(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose signatures allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(f"bits_{x}").to_pylist() for x in "ab"]
            widths = np.array([[len(bits) // 8 for bits in side] for side in sides])
            sizes = [batch.column(f"size_{x}").to_numpy().astype(np.int64) for x in "ab"]
            kept = np.zeros(batch.num_rows, bool)
            for pair in np.unique(widths, axis=1).T:
                at = np.flatnonzero((widths.T == pair).all(axis=1))
                first, second = (
                    fold(np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), width).T, pair.min())
                    for side, width in zip(sides, pair))
                different = np.bitwise_count(first ^ second).sum(0, dtype=np.int64)
                kept[at] = may_link(sizes[0][at], sizes[1][at], different)
            yield pa.RecordBatch.from_arrays(
                [batch.column(x).filter(pa.array(kept)) for x in "ab"], ["a", "b"])

    side = lambda x: nodes.select(
        F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _of_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents that may be among the rows (``doc_id``, ``text_key``) of ``wanted``.

    Rows are marked in a bitmap of a fixed 2 ** 26 bits, so 8 MB at most are broadcast, and texts that
    nobody asked for are seldom shuffled.
    """
    place = lambda: F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 << 26))
    marks = wanted.select(place().alias("place")).groupBy(
        F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks"))
    bit = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring(F.col("marks"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, (bit % 8).cast("int")) == 1
    return docs.withColumn("bucket", F.bitmap_bucket_number(place())).join(
        F.broadcast(marks), "bucket").where(marked).drop("bucket", "marks")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs whose sets are similar, by exact intersection.

    The texts of all ``a`` go to their ``b``, whose set is made once; a ``b`` with many partners is
    dealt out to parts of ``CROWD``, each with its text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, at, hub_set = Shingler(size), None, None
        for batch, sets in _sets(batches, shingler):
            found = []
            for hub, node, shingles in zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), sets):
                if _digest(shingles) != node:
                    continue  # texts are joined by a hash
                if node == hub:
                    at, hub_set = hub, shingles
                elif at == hub:
                    common = len(np.intersect1d(shingles, hub_set, assume_unique=True))
                    if DENOMINATOR * common >= NUMERATOR * (len(shingles) + len(hub_set) - common):
                        found.append((node, hub))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["a", "b"])

    pairs = materialize(pairs.distinct(), "pairs")
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    members = pairs.join(crowd, "b").select(
        F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"))
    hubs = crowd.select(F.col("b").alias("node"), F.col("b").alias("hub"),
                        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    seats = materialize(members.unionByName(hubs).join(nodes.select("node", "first"), "node").select(
        "hub", "part", "node", "first.doc_id", "first.text_key"), "seats")
    texts = _of_rows(docs.withColumn("text_key", text_key(F.col("text"))), seats)
    same = texts["doc_id"].eqNullSafe(seats["doc_id"]) & (texts["text_key"] == seats["text_key"])
    seated = texts.join(seats, same).select("hub", "part", "node", "text")
    links = materialize(seated.repartition("hub", "part").sortWithinPartitions(
        "hub", F.col("node") != F.col("hub")).mapInArrow(run, "a long, b long").distinct(), "links")
    forget(pairs, seats)
    return links


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """Every node of a tile with the tile's hub; ``b`` is the hub."""
    degree = entries.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = entries.join(degree, "node").groupBy("key").agg(
        F.max(F.struct("degree", "node", "size")).alias("hub"))
    return entries.join(hubs, "key").where(
        (F.col("node") != F.col("hub.node")) & similar_sizes(F.col("size"), F.col("hub.size"))).select(
        F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def _forest(pairs: np.ndarray, different: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of pairs of row numbers, those that join classes not joined before, the likeliest first."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    chosen = []
    for at in np.argsort(different, kind="stable"):
        first, second = (find(x) for x in label[pairs[at]].tolist())
        if first != second:
            top[max(first, second)] = min(first, second)
            chosen.append(at)
    return pairs[chosen]


def _rest_pairs(entries: DataFrame, classes: DataFrame, nodes: DataFrame, forest: bool) -> DataFrame:
    """Pairs (``key, a, b``) of a tile that lie in different classes so far and that signatures allow:
    all of them, or as many as join the classes of a tile (``forest``).

    A large tile is cut by bands of sizes, of which only equal and neighbouring ones hold partners,
    and into blocks, each pair of blocks being a task's work.
    """
    labelled = entries.where("n > 2").join(classes, "node", "left").withColumn(
        "label", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.where("low <> high").select("key")
    rows = labelled.join(mixed, "key").join(nodes.select("node", "bits"), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(DENOMINATOR / NUMERATOR))).cast("int")
    steps = F.when(F.col("n") > BLOCK // 8, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumns({
        "own": own, "band": F.when(F.col("n") > BLOCK // 8, band).otherwise(0)}).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn(
        "step", F.explode(steps)).select(
        "key", (F.col("band") + F.col("step")).alias("tile"), F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"), "own", "step", "size", "node", "label", "bits")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(b, np.uint64) for b in frame["bits"]]
        widths = np.array([len(w) for w in words])
        size, label, node = (frame[c].to_numpy(np.int64) for c in ("size", "label", "node"))
        lower, own = frame["step"].to_numpy() == 1, frame["own"].to_numpy()
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        found, bounds = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for width in np.unique(widths):
            # Sets of similar sizes have signatures of one width or of two neighbouring ones, and are
            # compared at the narrower of their own two.
            near = np.flatnonzero((widths == width) | (widths == 2 * width))
            bits = np.stack([fold(words[k], width) for k in near])
            narrow = widths[near] == width
            for row, at in enumerate(near):
                if lower[at]:
                    continue
                # A band against itself once, against the lower band always; across the two blocks.
                other = (lower[near] | (node[near] > node[at])) & (label[near] != label[at])
                if not narrow[row]:
                    other &= narrow
                if i != j:
                    other &= own[near] != own[at]
                other &= DENOMINATOR * np.minimum(size[near], size[at]) >= NUMERATOR * np.maximum(size[near], size[at])
                there = np.flatnonzero(other)
                if len(there):
                    different = np.bitwise_count(bits[there] ^ bits[row]).sum(1, dtype=np.int64)
                    may = may_link(size[near[there]], size[at], different)
                    found.append(np.stack([np.full(may.sum(), at), near[there[may]]], 1))
                    bounds.append(different[may])
        pairs = np.concatenate(found)
        if forest:
            pairs = _forest(pairs, np.concatenate(bounds), label)
        ends = np.sort(node[pairs], axis=1)
        return pd.DataFrame({"key": frame["key"].iloc[0], "a": ends[:, 1], "b": ends[:, 0]})

    keys = ["key", "tile", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            starts = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
            ends = [*starts[1:], len(frame)]
            out = [compare(frame.iloc[s:e]) for s, e in zip(starts[:-1], ends) if e - s > 1]
            rest = frame.iloc[starts[-1]:]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) > 1:
            yield compare(rest)

    # Rows of a tile lie in one task; a tile holds two bands of two blocks at most.
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(
        run, "key long, a long, b long")


def row_classes(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, first`` for each row: see ``near_duplicates``.

    ``first`` says whether the row is its class's first: the one with the smallest number, rows
    without one last, then by text.  Rows equal in number and text are first together; rows without
    shingles are classes of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    survey = materialize(_survey(docs, shingle_words), "survey")
    frequent = survey.where("shingle is not null").groupBy("shingle").agg(
        F.sum("count").alias("n")).orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).toPandas()
    often = frequent["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(often)
    # Places from the least frequent, 1, to the most frequent.
    parts = -(-frequent["n"].to_numpy(np.int64) // PART)
    frequent = spark.sparkContext.broadcast(
        (often[order], (len(order) - order).astype(np.int64), parts[order]))

    rows = survey.where("shingle is null and size is not null").select(
        "doc_id", "text_key", "size", "node", "bits")
    place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(
        F.min(place).alias("first"), F.first("size").alias("size"),
        F.first("bits").alias("bits")), "nodes")
    entries = _tiles(_entries(docs, shingle_words, frequent), nodes)

    hub_pairs = materialize(_bits_differ(_hub_pairs(entries), nodes), "hubs")
    links = _verified(hub_pairs, nodes, docs, shingle_words)
    forget(hub_pairs)
    for forest in (True, False):
        classes = components(links)
        rest = materialize(_rest_pairs(entries, classes, nodes, forest), "rest")
        forget(classes)
        links = links.unionByName(_verified(rest.select("a", "b"), nodes, docs, shingle_words))
        # A tile without a pair so far has none later: classes only grow.
        entries = entries.join(rest.select("key").distinct(), "key", "left_semi")
    classes = components(links)
    least = classes.join(nodes.select("node", "first"), "node").groupBy("component").agg(
        F.min("first").alias("least"))
    reach = nodes.select("node", "first").join(
        classes.join(least, "component").select("node", "least"), "node", "left").select(
        "node", F.coalesce("least", "first").alias("least"))
    return rows.join(reach, "node", "left").select(
        "doc_id", "text_key", F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        (F.col("node").isNull() | (place == F.col("least"))).alias("first"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document.

    Documents link when their sets of distinct shingles have a Jaccard similarity of at least 4/5;
    ``component_id`` is the smallest ``doc_id`` that links reach.  ``docs`` has ``doc_id`` and
    ``text``; other columns are not read.  Null, empty and blank texts have no shingles and are
    linked with nothing.  A null ``doc_id`` stands for itself alone unless documents with a number
    reach it; repeated rows are linked documents.  An empty table gives no rows.
    """
    return row_classes(docs, shingle_words).select("doc_id", "n_shingles", "component_id")
