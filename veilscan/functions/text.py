"""Text measures: entropy, alphabet class, masking, hashing, trimming."""

from __future__ import annotations

from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, types
from pyspark.sql import functions as F

# Code points that ECMAScript's trim() removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Entropy floors per alphabet and the shortest token that is judged.
ENTROPY_FLOOR = {"hex": 3.0, "base64": 4.2, "ascii": 4.5}
MIN_TOKEN_LENGTH = 16

# Masking keeps a quarter of the secret, at most four characters.
MASK_ALL_UP_TO = 6
MASK_REVEAL_MAX = 4
MASK_REVEAL_SHARE = 0.25


def built_once(build):
    """Keep the column a function without arguments builds, for as long as the JVM lives.

    A column expression is a description that any plan may use.  The larger ones here take
    thousands of calls to the JVM to put together.
    """
    kept: dict[int, tuple[object, Column]] = {}

    @wraps(build)
    def get() -> Column:
        gateway = SparkContext._gateway
        if id(gateway) not in kept:
            kept[id(gateway)] = (gateway, build())
        return kept[id(gateway)][1]

    return get


def js_trim(text: Column) -> Column:
    """Strip Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def js_trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for empty or missing text."""
    n = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n,
    )
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def rounded_entropy(text: Column) -> Column:
    """Entropy at nine decimals, so that the last bits do not decide a threshold."""
    return F.round(shannon_entropy(text), 9)


@F.arrow_udf(types.DoubleType())
def _entropies(text: pa.Array) -> pa.Array:
    """Entropy of each text of a batch: equal characters of a text are counted by one sort."""
    size = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(filter(None, text.to_pylist())).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(size)), size)
    keys, counts = np.unique(row << 21 | chars, return_counts=True)
    share = counts / size[keys >> 21]
    bits = np.bincount(keys >> 21, -share * np.log2(share), len(size))
    return pa.array(bits, mask=text.is_null().to_numpy(zero_copy_only=False))


def rounded_entropies(text: Column, engine: str = "arrow") -> Column:
    """``rounded_entropy`` of whole batches; null for missing text."""
    if engine == "jvm":
        return F.when(text.isNotNull(), rounded_entropy(text))
    return F.round(_entropies.asNondeterministic()(text), 9)


def charset(text: Column) -> Column:
    """Alphabet class of a token: hex, base64 or ascii."""
    return (
        F.when(text.rlike(r"^[0-9a-fA-F]+\z"), "hex")
        .when(text.rlike(r"^[a-zA-Z0-9+/=_-]+\z"), "base64")
        .otherwise("ascii")
    )


def entropy_floor(text: Column) -> Column:
    kind = charset(text)
    return (
        F.when(kind == "hex", ENTROPY_FLOOR["hex"])
        .when(kind == "base64", ENTROPY_FLOOR["base64"])
        .otherwise(ENTROPY_FLOOR["ascii"])
    )


def is_high_entropy(text: Column, entropy: Column) -> Column:
    """Long enough, and random enough for its alphabet."""
    return (F.length(text) >= MIN_TOKEN_LENGTH) & (entropy >= entropy_floor(text))


def mask(secret: Column) -> Column:
    """Hide a secret, keeping a few characters at both ends of longer ones."""
    n = F.length(secret)
    shown = F.least(F.lit(MASK_REVEAL_MAX), F.floor(n * MASK_REVEAL_SHARE).cast("int"))
    head = F.floor(shown / 2).cast("int")
    tail = shown - head
    partly = F.concat(
        F.left(secret, head), F.repeat(F.lit("*"), n - shown), F.right(secret, tail))
    return F.when(n <= MASK_ALL_UP_TO, F.repeat(F.lit("*"), n)).otherwise(partly)


def sha256_of(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    cols = [p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(":", *cols) if len(cols) > 1 else cols[0], 256)


def secret_hash(path: Column, rule_id: Column, secret: Column) -> Column:
    """Identity of a secret within its file and rule."""
    return sha256_of(path, rule_id, secret)


def printable(text: Column, share: float = 0.8) -> Column:
    """True when enough of a non-empty text is printable ASCII, tab or line break."""
    kept = F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\n\r]", ""))
    return (F.length(text) > 0) & (kept / F.length(text) >= share)
