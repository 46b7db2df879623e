"""The cheap look at every text that decides which few deserve the costly ones.

``java.util.regex`` tries the branches of an alternation one by one, and a catalog of two hundred
rules needs an alternation of as many words.  RE2 runs the same alternation as one automaton, so
the screen is an Arrow UDF around Arrow's vectorised RE2 kernel.  It only ever lets too much
through: everything it passes is matched again, exactly, by built-in expressions.
``engine="jvm"`` does the same work without Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.codecs import (
    BASE58_ALPHABET,
    BASE58_MIN_DISTINCT,
    BASE58_MIN_LENGTH,
    OTHER_SCREEN,
    OTHER_SCREENS,
)
from veilscan.functions.normalize import REWRITE_SCREEN
from veilscan.rules import RuleSet

HIT, JOINED_HIT, REWRITE, DECODABLE = 1, 2, 4, 8
# The decoders that may make something out of a decodable text stand above these bits, and above them those
# for the text behind the wrapped line before it.
CODEC_UNIT = 16
JOINED_UNIT = CODEC_UNIT << 8
# What a decodable text may hold: something for each decoder by itself, numbered as in ``codecs.DECODERS``.
BASE64, PERCENT, HEX, BASE32, BYTE_LIST, REVERSED, BASE58, ASCII85 = (1 << i for i in range(8))
ALL_CODECS = 255
# Bytes of text that the keyword look-up holds numbers for at a time.
WINDOW_BYTES = 1 << 20
# Bytes of texts whose runs are decoded at a time, which takes some fifty times as much memory; one text at least.
RUN_BYTES = 1 << 18
# Texts go to a worker in batches of about so many bytes, or of one text.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_short_batches(df: DataFrame) -> DataFrame:
    """Have long texts go to the workers in short batches.

    Each pass through Python holds a batch for each core: twice outside the heap, several times in its worker.
    Spark's 64 MB come to gigabytes beside the heap.  There is no such setting for a query, so that it is the
    session's; a value that is set already is left.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    return df


def _compiles(pattern: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), pattern, ignore_case=True)
        return True
    except pa.ArrowInvalid:
        return False


def _texts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and the last ends, and the bytes that they lie in."""
    held = text.cast(pa.large_binary())
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int64)[held.offset:held.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    return ends, np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)


def _alphabet(*characters: str) -> np.ndarray:
    """For each byte its place in an alphabet, the later of two where they differ; -1 for all others."""
    places = np.full(256, -1, np.int16)
    for alphabet in characters:
        places[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    return places


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE64 = _alphabet(_LETTERS + _LETTERS.lower() + "0123456789+/", _LETTERS + _LETTERS.lower() + "0123456789-_")
_HEX = _alphabet("0123456789ABCDEF", "0123456789abcdef")
_BASE32 = _alphabet(_LETTERS + "234567", _LETTERS.lower() + "234567") >= 0
_BASE58 = _alphabet(BASE58_ALPHABET)
_BYTES = np.arange(256)
_PRINTABLE = ((_BYTES >= 32) & (_BYTES < 127)) | np.isin(_BYTES, (9, 10, 13))
# What a byte counts for in a text of UTF-8: a printable one, another of ASCII, a first byte, any of the rest.
_KIND = np.where(_PRINTABLE, 0, np.where(_BYTES < 128, 1, np.where(_BYTES >= 0xC0, 2, 3)))


def _may_be_printable(made: np.ndarray, run: np.ndarray, runs: int) -> np.ndarray:
    """Whether bytes made out of each run may be a text that ``printable`` accepts.

    A character has at most four bytes, and at most one first byte; so may what replaces invalid ones.
    """
    count = np.bincount(run * 4 + _KIND[made], minlength=runs * 4).reshape(runs, 4)
    kept, control, first, rest = count.T
    others = control + np.maximum(first, -(-(first + rest) // 4))
    return (kept > 0) & (kept * 10 >= (kept + others) * 8)


def _base58_number(digits: list[int]) -> int:
    """By halving, so that long runs stay below the square of their length."""
    if len(digits) > 128:
        half = len(digits) // 2
        return _base58_number(digits[:half]) * 58 ** (len(digits) - half) + _base58_number(digits[half:])
    number = 0
    for digit in digits:
        number = number * 58 + digit
    return number


def _base58_bytes(digits: list[int]) -> bytes:
    """The bytes of a Base58 number; each zero in front is one more."""
    number = _base58_number(digits)
    zeroes = next((i for i, digit in enumerate(digits) if digit), len(digits))
    return bytes(zeroes) + number.to_bytes(max(1, -(-number.bit_length() // 8)), "big")


def _may_be_base58(digits: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether Base58 may make a text out of each of the runs that lie one behind the other in ``digits``."""
    seen = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), digits.astype(np.uint64)), first)
    varied = np.flatnonzero(np.bitwise_count(seen) >= BASE58_MIN_DISTINCT)
    may = np.zeros(len(first), bool)
    if len(varied):
        made = [_base58_bytes(digits[first[i]:first[i] + sizes[i]].tolist()) for i in varied]
        run = np.repeat(np.arange(len(made)), [len(m) for m in made])
        may[varied] = _may_be_printable(np.frombuffer(b"".join(made), np.uint8), run, len(made))
    return may


def _run_codecs(text: pa.Array, base58: bool = False) -> np.ndarray:
    """Which of Base64, hexadecimal and Base32 may make a text out of a run of token characters (bits).

    With ``base58`` these are runs of that alphabet, and Base58 is looked at as well.  All runs of a batch are
    decoded at once as bytes.  Texts beyond ``WINDOW_BYTES`` are not looked at.
    """
    ends, data = _texts(text)
    alphabet, shortest = (_BASE58, BASE58_MIN_LENGTH) if base58 else (_BASE64, 16)
    out = np.where(np.diff(ends) > WINDOW_BYTES, BASE64 | HEX | BASE32 | BASE58 * base58, 0)
    row = 0
    while row < len(text):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + RUN_BYTES, "right")) - 1)
        if not out[row]:
            part = data[ends[row]:ends[last]]
            known = alphabet[part] >= 0
            begins = ends[row:last][ends[row:last] < ends[last]] - ends[row]
            after = np.concatenate([[False], known[:-1]])
            after[begins] = False
            starts = np.flatnonzero(known & ~after)
            stops = np.concatenate([~known | ~after, [True]])
            edges = np.flatnonzero(stops)
            sizes = edges[np.searchsorted(edges, starts, "right")] - starts
            starts, sizes = starts[sizes >= shortest], sizes[sizes >= shortest]
            if len(starts):
                run = np.repeat(np.arange(len(starts)), sizes)
                first = np.cumsum(sizes) - sizes
                at = np.arange(len(run)) - np.repeat(first, sizes)
                chars = part[np.repeat(starts, sizes) + at]
                pair = run[:-1] == run[1:]
                may = np.logical_and.reduceat(_BASE32[chars], first) * BASE32
                step = at[:-1] % 4
                use = pair & (step < 3)
                value, step = _BASE64[chars].astype(np.int32), step[use]
                made = ((value[:-1][use] << (2 + 2 * step)) & 255) | (value[1:][use] >> (4 - 2 * step))
                may |= _may_be_printable(made, run[:-1][use], len(starts)) * BASE64
                value = _HEX[chars].astype(np.int32)
                digits = np.bincount(run, value < 0, len(starts)) == 0
                use = pair & (at[:-1] % 2 == 0) & digits[run[:-1]]
                made = value[:-1][use] << 4 | value[1:][use]
                may |= _may_be_printable(made, run[:-1][use], len(starts)) * HEX
                if base58:
                    may |= _may_be_base58(_BASE58[chars], first, sizes) * BASE58
                rows = np.searchsorted(ends, starts[may > 0] + ends[row], "right") - 1
                np.bitwise_or.at(out, rows, may[may > 0])
        row = last
    return out


def _decodable(text: pa.Array) -> np.ndarray:
    """Whether Base64, hexadecimal or Base32 may make a text out of a run of token characters."""
    return _run_codecs(text) > 0


def _codecs(text: pa.Array) -> np.ndarray:
    """Which decoders may make a text out of a token of each text (bits of ``ALL_CODECS``).

    Tokens for the other decoders can be Base64, hexadecimal or Base32 as well, from any of their characters on.
    Where only Base58 has tokens, these are decoded too: random ones, which are many, give no text.
    """
    out = _run_codecs(text)
    some = pc.fill_null(pc.match_substring_regex(text, OTHER_SCREEN), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(some)
    if len(at):
        part, others = text.take(pa.array(at)), np.zeros(len(at), np.int64)
        for name, pattern in OTHER_SCREENS.items():
            found = pc.match_substring_regex(part, pattern).to_numpy(zero_copy_only=False)
            others |= found * globals()[name]
        alone = others == BASE58
        if alone.any():
            others[alone] = (_run_codecs(part.filter(pa.array(alone)), base58=True) > 0) * BASE58
        out[at] |= np.where(others > 0, others | BASE64 | HEX | BASE32, 0)
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _codecs_of(texts: pa.Array) -> pa.Array:
    """The same for each text of an array."""
    bits = pa.array(_codecs(texts.flatten()), pa.int32())
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, bits)


def codecs_of(texts: Column, engine: str = "arrow") -> Column:
    """For each text of an array the decoders that may make something out of its tokens (array<int>)."""
    if engine == "jvm":
        return F.transform(texts, lambda t: F.lit(ALL_CODECS))
    return _codecs_of.asNondeterministic()(texts)


def _flags(tests: list[tuple[int, str | None, bool]], decode: bool):
    """Function over Arrow arrays that sets bit ``flag`` where ``pattern`` is found (always, when it is None)."""
    def flags(text: pa.Array, joined: pa.Array | None) -> pa.Array:
        total = pa.array([0] * len(text), pa.int32())
        for flag, pattern, ignore_case in tests:
            if pattern is None:
                found = pa.array([flag] * len(text), pa.int32())
            else:
                found = pc.multiply(
                    pc.match_substring_regex(text, pattern, ignore_case=ignore_case)
                    .cast(pa.int32()), flag)
            total = pc.add(total, found)
        if decode:
            bits = _codecs(text)
            bits = bits * CODEC_UNIT + (bits > 0) * DECODABLE
            if joined is not None:
                at = np.flatnonzero(joined.is_valid().to_numpy(zero_copy_only=False))
                behind = joined.take(pa.array(at))
                bits[at] += _codecs(behind) * JOINED_UNIT
                for flag, pattern, ignore_case in tests:
                    if flag == HIT and len(at):
                        bits[at] += JOINED_HIT * (pattern is None or pc.match_substring_regex(
                            behind, pattern, ignore_case=ignore_case).to_numpy(zero_copy_only=False))
            total = pc.add(total, pa.array(bits, pa.int32()))
        return total.cast(pa.int32())

    return flags


def screen(
    text: Column, rules: RuleSet, *, decode: bool = True, rewrite: bool = True,
    engine: str = "arrow", joined: Column | None = None,
) -> Column:
    """Bit set of what a text may hold: a finding, something to normalise, whether an encoded token may be
    decodable, and by which decoders (``CODEC_UNIT``).

    ``joined`` is the text behind the wrapped line before it, or null; for it whether it may hold a finding
    (``JOINED_HIT``) and the decoders (``JOINED_UNIT``) are told."""
    if engine == "jvm":
        flags = F.when(rules.may_match(text), HIT).otherwise(0)
        if decode:
            flags = flags + F.lit(JOINED_HIT + DECODABLE + ALL_CODECS * (CODEC_UNIT + JOINED_UNIT))
        if rewrite:
            flags = flags + F.lit(REWRITE)
        return flags
    if engine != "arrow":
        raise ValueError(f"unknown screen engine {engine!r}")
    tests: list[tuple[int, str | None, bool]] = []
    anchors = rules.anchor_re2
    if anchors is not None:
        tests.append((HIT, anchors if _compiles(anchors) else None, True))
    if rewrite:
        tests.append((REWRITE, REWRITE_SCREEN, False))
    if not tests and not decode:
        return F.lit(0)
    # Declared non-deterministic so that no filter above is moved below it and the call is not
    # repeated: the point of the screen is that costlier predicates run after it.
    flags = _flags(tests, decode)

    @F.arrow_udf(T.IntegerType())
    def of_text(text: pa.Array) -> pa.Array:
        return flags(text, None)

    @F.arrow_udf(T.IntegerType())
    def of_both(text: pa.Array, joined: pa.Array) -> pa.Array:
        return flags(text, joined)

    found = of_text.asNondeterministic()(text) if joined is None else of_both.asNondeterministic()(text, joined)
    return F.coalesce(found, F.lit(0))


def _keyword_gate(owners: dict[str, list[int]], always: list[int], n_rules: int):
    """Arrow UDF that lists the rules of the keywords in each lower-case text.

    Of each keyword the first bytes, at most four, are a number.  The texts of a batch lie one behind the
    other, and a table tells the few places where such a number stands; there the whole word is compared.
    """
    starts: dict[int, dict[int, list[tuple[bytes, list[int]]]]] = {}
    for word, rules in owners.items():
        raw = word.encode()
        size = min(len(raw), 4)
        code = int.from_bytes(raw[:size], "little")
        starts.setdefault(size, {}).setdefault(code, []).append((raw, rules))
    ahead = max(4, *(len(word.encode()) for word in owners))
    known = {}
    for size, words in starts.items():
        known[size] = np.zeros(1 << 16, bool)
        known[size][[_hashed(code) for code in words]] = True

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def gate(text: pa.Array) -> pa.Array:
        n = len(text)
        ends, data = _texts(text)
        pairs = []
        for begin in range(int(ends[0]), int(ends[-1]), WINDOW_BYTES):
            end = min(begin + WINDOW_BYTES, int(ends[-1]))
            window = np.zeros(end - begin + ahead, np.uint8)
            part = data[begin:min(end + ahead, int(ends[-1]))]
            window[:len(part)] = part
            codes = np.zeros(end - begin, np.uint32)
            for size in range(1, 5):
                codes |= window[size - 1:size - 1 + end - begin].astype(np.uint32) << np.uint32(8 * (size - 1))
                if size not in starts:
                    continue
                at = np.flatnonzero(known[size][_hashed(codes)])
                at = at[np.argsort(codes[at], kind="stable")]
                found = codes[at].astype(np.int64)
                for code, words in starts[size].items():
                    first, last = np.searchsorted(found, [code, code + 1])
                    for word, rules in words if last > first else ():
                        places = at[first:last]
                        for i in range(size, len(word)):
                            places = places[window[places + i] == word[i]]
                        rows = np.searchsorted(ends, places + begin, "right") - 1
                        rows = np.unique(rows[places + begin + len(word) <= ends[rows + 1]])
                        pairs += [rows * n_rules + rule for rule in rules]
        valid = text.is_valid().to_numpy(zero_copy_only=False)
        pairs += [np.flatnonzero(valid) * n_rules + rule for rule in always]
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        offsets = np.searchsorted(pairs // n_rules, np.arange(n + 1))
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(pairs % n_rules, pa.int32()), mask=pa.array(~valid))

    return gate


def _hashed(code):
    """Sixteen bits of a number of up to four bytes, or of an array of them."""
    return (code ^ (code >> 15)) & 0xFFFF


def candidate_rules(text: Column, rules: RuleSet, engine: str = "arrow") -> Column:
    """Positions of the rules whose keyword gate a text passes (array<int>)."""
    if engine == "jvm":
        return rules.candidate_rules(text)
    always = [rules.ids.index(rule.rule_id) for rule in rules.unkeyed]
    if not rules.keyword_owners:
        return rules.candidate_rules(text)
    return _keyword_gate(rules.keyword_owners, always, len(rules)).asNondeterministic()(F.lower(text))
