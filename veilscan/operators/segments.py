"""Lines to segments: the normalised line itself, and every text decoded out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import codecs
from veilscan.functions.normalize import joined_base64, normalize
from veilscan.functions.regex import let, match_spans
from veilscan.functions.text import built_once
from veilscan.operators import screen as S
from veilscan.operators.screen import (
    CODEC_UNIT,
    HIT,
    JOINED_UNIT,
    REWRITE,
    codecs_of,
    in_short_batches,
    screen,
)
from veilscan.rules import RuleSet

DEFAULT_DECODE_DEPTH = 3
MAX_DECODE_DEPTH = 10
DECODED_TYPE = "array<struct<depth:int,codec:string,text:string,offset:int>>"


def check_decode_depth(depth: int) -> int:
    if not isinstance(depth, int) or not 0 <= depth <= MAX_DECODE_DEPTH:
        raise ValueError(f"decode depth must be an integer from 0 to {MAX_DECODE_DEPTH}")
    return depth


#: Bits of a text without which a finder finds nothing that any decoder reads.
_FINDER_BITS = [S.BASE64 | S.HEX | S.BASE32, S.PERCENT, S.PERCENT, S.BYTE_LIST, S.REVERSED, S.BASE58, S.ASCII85]


def encoded_tokens(text: Column, bits: Column | None = None) -> Column:
    """Encoded tokens of a text, finder by finder: ``array<struct<hit, pos>>``.

    ``bits`` (of ``screen.codecs_of``) leaves out finders that have nothing to find.
    """
    none = F.array().cast("array<struct<hit:string,pos:int>>")
    may = [F.lit(True) if bits is None else bits.bitwiseAND(b) > 0 for b in _FINDER_BITS]
    return F.concat(*[
        F.when(here & text.rlike(finder), match_spans(text, finder)).otherwise(none)
        for here, finder in zip(may, codecs.FINDERS)
    ])


def _decoded(token: Column, offset: Column, bits: Column) -> Column:
    """What each decoder makes of one token: ``array<struct<text, offset, codec>>``."""
    made = F.array(*[
        F.struct(F.when(bits.bitwiseAND(1 << i) > 0, decode(token)).alias("text"), offset.alias("offset"),
                 F.lit(name).alias("codec"))
        for i, (name, decode) in enumerate(codecs.DECODERS.items())
    ])
    return F.filter(made, lambda d: d["text"].isNotNull())


def _expand(frontier: Column) -> Column:
    """Decode every token of every text of a frontier, in order."""
    def of_text(c):
        return F.flatten(F.transform(
            encoded_tokens(c["text"], c["bits"]), lambda t: _decoded(t["hit"], c["offset"] + t["pos"], c["bits"])))

    return F.flatten(F.transform(frontier, of_text))


@built_once
def _next_level() -> Column:
    """New texts out of the columns ``_frontier`` and ``_bits``, whatever level is in them."""
    empty = F.array().cast("array<struct<text:string,offset:int,codec:string>>")
    frontier = F.filter(
        F.zip_with("_frontier", "_bits", lambda d, bits: F.struct(
            d["text"].alias("text"), d["offset"].alias("offset"), bits.alias("bits"))),
        lambda d: d["bits"] > 0)
    made = let(frontier, lambda f: F.when(F.size(f) > 0, _distinct(_expand(f))).otherwise(empty))
    return F.when(F.size("_frontier") > 0, made).otherwise(empty)


def _distinct(found: Column) -> Column:
    """The first of each group of equal texts."""
    def firsts(items):
        texts = F.transform(items, lambda d: d["text"])
        return F.transform(
            F.array_distinct(texts),
            lambda t: F.element_at(items, F.array_position(texts, t).cast("int")))

    return let(found, firsts)


def _unknown(found: Column, known: list[Column]) -> Column:
    """Texts that no earlier level of the line has produced."""
    earlier = F.concat(*[F.transform(level, lambda d: d["text"]) for level in known])
    return F.filter(found, lambda d: ~F.array_contains(earlier, d["text"]))


def _with_decoded(
    df: DataFrame, column: str = "text", depth: int = DEFAULT_DECODE_DEPTH,
    needed: Column | None = None, bits: Column | None = None, engine: str = "arrow",
) -> DataFrame:
    """Add ``decoded``: ``array<struct<depth, codec, text, offset>>`` of all decodable tokens.

    Each level decodes the texts of the level before.  The levels are arrays within the row, so
    the input is read once and equal texts of one line are dropped without a shuffle.  ``bits`` are the
    decoders that the text itself is for, if known.
    """
    check_decode_depth(depth)
    empty = F.array().cast("array<struct<text:string,offset:int,codec:string>>")
    frontier = F.array(F.struct(
        F.col(column).alias("text"), F.lit(0).alias("offset"), F.lit("plain").alias("codec")))
    if needed is not None:
        frontier = F.when(needed, frontier).otherwise(empty)
    df = df.withColumn("_frontier", frontier)
    levels: list[str] = []
    for level in range(1, depth + 1):
        name = f"_level{level}"
        texts = F.transform("_frontier", lambda d: d["text"])
        # Few texts come out of a token: on a pass through Python for each level more, which takes workers for every
        # core whatever goes through them, they would save less than it costs in memory.
        here = F.array(bits) if level == 1 and bits is not None else codecs_of(texts, engine if level == 1 else "jvm")
        df = df.withColumn("_bits", here).withColumn(name, _next_level())
        if levels:
            df = df.withColumn(name, _unknown(F.col(name), [F.col(c) for c in levels]))
        df = df.withColumn("_frontier", F.col(name))
        levels.append(name)

    def labelled(level):
        return lambda d: F.struct(
            F.lit(level).alias("depth"), d["codec"].alias("codec"), d["text"].alias("text"),
            d["offset"].alias("offset"))

    every = [
        F.transform(F.col(name), labelled(level)) for level, name in enumerate(levels, 1)
    ]
    none = F.array().cast(DECODED_TYPE)
    return df.withColumn("decoded", F.concat(none, *every)).drop("_frontier", "_bits", *levels)


def decode_texts(
    df: DataFrame, column: str = "text", depth: int = DEFAULT_DECODE_DEPTH
) -> DataFrame:
    """One row per decoded text: the other columns plus ``depth, codec, text, offset``."""
    keep = [c for c in df.columns if c != column]
    decoded = F.concat(F.col("decoded"), F.array().cast(DECODED_TYPE))
    return _with_decoded(df, column, depth).select(
        *keep, F.explode(decoded).alias("_piece")).select(*keep, "_piece.*")


def to_segments(
    lines: DataFrame, rules: RuleSet, *, decode_depth: int = DEFAULT_DECODE_DEPTH,
    normalise: bool = True, engine: str = "arrow",
) -> DataFrame:
    """Texts that may hold a finding, one row each; lines of any length are taken whole.

    What is encoded more than ``decode_depth`` times over is not seen.

    Input: any columns with ``text`` and ``prev_text``.  Output: those columns, with ``text``
    replaced by the segment's text and ``line_text`` (the line as it was), ``depth``, ``codec``
    and ``offset`` (column shift) added.
    """
    check_decode_depth(decode_depth)
    decode = decode_depth > 0
    df = in_short_batches(lines).withColumn("_joined", joined_base64(F.col("text"), F.col("prev_text"))).withColumn(
        "_screen",
        screen(F.col("text"), rules, decode=decode, rewrite=normalise, engine=engine,
               joined=F.col("_joined") if decode else None))
    # Tokens that no decoder reads are no reason to look at a line again.
    df = df.where("_screen > 0").withColumn("line_text", F.col("text")).withColumn(
        "text", F.coalesce("_joined", "text"))
    rewrite = F.col("_screen").bitwiseAND(REWRITE) > 0
    if normalise:
        df = normalize(df, "text", rewrite)
    keep = [c for c in df.columns if c not in ("text", "_screen", "_joined")]
    plain = F.struct(
        F.lit(0).alias("depth"), F.lit("plain").alias("codec"), F.col("text").alias("text"),
        F.lit(0).alias("offset"))
    pieces = F.array(plain)
    if normalise:
        raw = F.struct(
            F.lit(0).alias("depth"), F.lit("raw").alias("codec"),
            F.col("line_text").alias("text"), F.lit(0).alias("offset"))
        pieces = F.when(
            F.col("text") != F.col("line_text"), F.array(plain, raw)).otherwise(pieces)
    if decode:
        # The screen saw the line and the line behind a wrapped one, but not what normalisation makes of them.
        def seen(unit):
            return F.shiftright("_screen", unit.bit_length() - 1).bitwiseAND(S.ALL_CODECS)

        bits = F.when(F.col("text") == F.col("line_text"), seen(CODEC_UNIT)).when(
            F.col("text") == F.col("_joined"), seen(JOINED_UNIT)).otherwise(S.ALL_CODECS)
        needed = bits > 0
        df = _with_decoded(df, "text", decode_depth, needed, bits, engine)
        pieces = F.concat(pieces, F.col("decoded"))
    df = df.select(*keep, F.explode(pieces).alias("_piece")).select(
        *keep, "_piece.depth", "_piece.codec", "_piece.text", "_piece.offset")
    hit = screen(F.col("text"), rules, decode=False, rewrite=False, engine=engine)
    return df.withColumn("_screen", hit).where(
        F.col("_screen").bitwiseAND(HIT) > 0).drop("_screen")
