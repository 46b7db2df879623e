"""Decoders for one encoded token, and the finders that pick tokens out of a text.

A decoder returns the decoded text, or null when the token is not in its encoding.  All of them are
built-in expressions; inside the expansion they run as lambdas over the tokens of one text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.regex import let
from veilscan.functions.text import printable

# Token finders, decoder alphabets and the reversed vendor prefixes.
BASE64_TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+"
PERCENT_PAIRS = r"(?i)(?:%[0-9a-f]{2}){2,}+[A-Za-z0-9%._~!$\&'()*+,;=:@/?-]*+"
PERCENT_TOKEN = r"(?i)(?:%[0-9a-f]{2})++[A-Za-z0-9%._~!$\&'()*+,;=:@/?-]*+"
BYTE_ITEM = r"(?:\d{2,3}|0x[0-9a-fA-F]{2})"
BYTE_ARRAY = rf"(?:\[|(?<!\w)Buffer\.from\(\[)((?:{BYTE_ITEM}\s*,\s*){{15,}}+{BYTE_ITEM})\]"
REVERSED_PREFIXES = r"(?:_phg|-_taplg|_evil_ks|_-xox|AIKA)(?!\w)"
REVERSED_SUFFIX = r"[A-Za-z0-9_\-]{15,}" + REVERSED_PREFIXES
# The same looked for from its end, which takes linear time whatever stands before.
REVERSED_END = r"(?i)(?<=[A-Za-z0-9_\-]{15})" + REVERSED_PREFIXES
# From the start of a run of token characters, so that a long run is read once.
REVERSED_TOKEN = rf"(?i)(?<!\w)(?<!\w-)(?=\w){REVERSED_SUFFIX}"
BASE58_MIN_LENGTH = 30
BASE58_TOKEN = rf"[1-9A-HJ-NP-Za-km-z]{{{BASE58_MIN_LENGTH},}}"
ASCII85_TOKEN = r"<~[!-u]+~>"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE58_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE58_MIN_DISTINCT = 15

# RE2 patterns of texts that hold a token for the decoders other than Base64, hexadecimal and Base32.
OTHER_SCREENS = {
    "PERCENT": r"%[0-9a-fA-F]{2}", "ASCII85": r"<~[!-u]+~>",
    "BYTE_LIST": r"(?:(?:\d{2,3}|0x[0-9a-fA-F]{2})[\s\v]*,[\s\v]*){15}",
    "BASE58": r"[1-9A-HJ-NP-Za-km-z]{30}", "REVERSED": r"(?i:_phg|-_taplg|_evil_ks|_-xox|aika)",
}
OTHER_SCREEN = "|".join(OTHER_SCREENS.values())


def _utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def _if_printable(text: Column) -> Column:
    return let(text, lambda t: F.when(printable(t), t))


def base64(token: Column) -> Column:
    """Base64 and Base64URL; other characters are skipped, a dangling one is dropped."""
    plain = F.translate(token, "-_", "+/")
    # Most tokens have nothing to skip; a possessive run tells so in a tenth of the replacement's time.
    clean = F.when(token.rlike(r"^[A-Za-z0-9+/_-]*+\z"), plain).otherwise(
        F.regexp_replace(plain, "[^A-Za-z0-9+/]", ""))

    def decode(c):
        whole = F.left(c, F.length(c) - F.when(F.length(c) % 4 == 1, 1).otherwise(0))
        padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "=")
        return _if_printable(_utf8(F.try_to_binary(padded, F.lit("base64"))))

    return let(clean, lambda c: F.when(F.length(c) > 1, decode(c)))


def percent(token: Column) -> Column:
    """Percent-encoding of valid UTF-8."""
    decoded = F.try_url_decode(F.replace(token, F.lit("+"), F.lit("%2B")))
    plain = let(decoded, lambda d: F.when((d != token) & ~d.contains("�") & (d != ""), d))
    return F.when(token.contains("%"), plain)


def hexadecimal(token: Column) -> Column:
    even = F.left(token, (F.floor(F.length(token) / 2) * 2).cast("int"))
    return F.when(token.rlike(r"^[0-9a-fA-F]{16,}+\z"), _if_printable(_utf8(F.unhex(even))))


def _char_value(alphabet: str, char: Column) -> Column:
    return (F.instr(F.lit(alphabet), char) - 1).cast("bigint")


def _groups(text: Column, size: int) -> Column:
    """Cut a non-empty text into pieces of ``size`` characters."""
    last = (F.ceil(F.length(text) / size) - 1).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def _number(text: Column, base: int, alphabet: str) -> Column:
    return F.aggregate(
        F.split(text, ""), F.lit(0).cast("bigint"),
        lambda acc, c: acc * base + _char_value(alphabet, c))


def base32(token: Column) -> Column:
    """Base32 without regard to case; bits beyond the last whole byte are dropped."""
    clean = F.upper(F.regexp_replace(token, r"=+\z", ""))

    def decode(c):
        blocks = F.transform(
            _groups(c, 8),
            lambda g: F.lpad(F.hex(_number(F.rpad(g, 8, "A"), 32, BASE32_ALPHABET)), 10, "0"))
        digits = (F.floor(F.length(c) * 5 / 8) * 2).cast("int")
        return _if_printable(_utf8(F.unhex(F.left(F.array_join(blocks, ""), digits))))

    return let(clean, lambda c: F.when(c.rlike(r"^[A-Z2-7]{16,}+\z"), decode(c)))


def byte_array(token: Column) -> Column:
    """A literal list of at least sixteen byte values, decimal or 0x."""
    items = F.transform(F.split(F.regexp_extract(token, BYTE_ARRAY, 1), ","), lambda s: F.trim(
        F.regexp_replace(s, r"\s+", "")))

    def value(item):
        return F.when(item.startswith("0x"), F.conv(F.substring(item, 3, 2), 16, 10)).otherwise(
            item).cast("int")

    def decode(values):
        pairs = F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0"))
        return F.when(
            F.forall(values, lambda v: v <= 255),
            _if_printable(_utf8(F.unhex(F.array_join(pairs, "")))))

    return F.when(token.rlike(BYTE_ARRAY), let(F.transform(items, value), decode))


def reversed_token(token: Column) -> Column:
    """A token written backwards, known by the reversed prefix at its end."""
    return F.when(token.rlike(REVERSED_END), F.reverse(token))


def base58(token: Column) -> Column:
    """Base58: the number is kept as 24-bit limbs, and four digits are taken in per step."""
    mask, bits = (1 << 24) - 1, 24
    limbs_type = "array<bigint>"

    def push(limbs, digits):
        start = F.struct(
            _number(digits, 58, BASE58_ALPHABET).alias("carry"),
            F.array().cast(limbs_type).alias("out"))
        factor = F.pow(F.lit(58.0), F.length(digits)).cast("bigint")

        def step(state, limb):
            return let(limb * factor + state["carry"], lambda v: F.struct(
                F.shiftright(v, bits).alias("carry"),
                F.concat(state["out"], F.array(v.bitwiseAND(F.lit(mask)))).alias("out")))

        def close(state):
            return F.when(
                state["carry"] > 0, F.concat(state["out"], F.array(state["carry"]))
            ).otherwise(state["out"])

        return F.aggregate(limbs, start, step, close)

    def decode(t):
        limbs = F.aggregate(_groups(t, 4), F.array().cast(limbs_type), push)
        text = F.array_join(
            F.transform(F.reverse(limbs), lambda v: F.lpad(F.hex(v), 6, "0")), "")
        even = let(F.regexp_replace(text, "^0+", ""), lambda number: F.when(number == "", F.lit("00")).otherwise(
            F.lpad(number, (F.ceil(F.length(number) / 2) * 2).cast("int"), "0")))
        zeroes = F.length(F.regexp_extract(t, "^1*", 0))
        return _if_printable(_utf8(F.unhex(F.concat(F.repeat(F.lit("00"), zeroes), even))))

    fits = token.rlike(rf"^{BASE58_TOKEN}\z")
    varied = F.size(F.array_distinct(F.split(token, ""))) >= BASE58_MIN_DISTINCT
    return F.when(fits, F.when(varied, decode(token)))


def ascii85(token: Column) -> Column:
    """ASCII85 between ``<~`` and ``~>``; a group beyond 32 bits makes the token invalid."""
    payload = F.substring(token, F.lit(3), F.length(token) - 4)

    def group_value(g):
        return F.aggregate(
            F.split(F.rpad(g, 5, "u"), ""), F.lit(0).cast("bigint"),
            lambda acc, c: acc * 85 + (F.ascii(c) - 33))

    def decode(p):
        n = F.length(p)
        rest = n % 5
        digits = (F.floor(n / 5) * 8 + F.when(rest > 0, (rest - 1) * 2).otherwise(0)).cast("int")

        def join(values):
            blocks = F.transform(values, lambda v: F.lpad(F.hex(v), 8, "0"))
            return F.when(
                F.forall(values, lambda v: v < (1 << 32)) & (rest != 1),
                _if_printable(_utf8(F.unhex(F.left(F.array_join(blocks, ""), digits)))))

        return let(F.transform(_groups(p, 5), group_value), join)

    return F.when(token.rlike(r"^<~[!-u]+~>\z"), let(payload, decode))


# Order in which finders and decoders are applied to a text.
FINDERS = [
    BASE64_TOKEN, PERCENT_PAIRS, PERCENT_TOKEN, BYTE_ARRAY, REVERSED_TOKEN, BASE58_TOKEN,
    ASCII85_TOKEN,
]
DECODERS = {
    "base64": base64, "percent": percent, "hex": hexadecimal, "base32": base32,
    "bytes": byte_array, "reversed": reversed_token, "base58": base58, "ascii85": ascii85,
}
