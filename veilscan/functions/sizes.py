"""Byte-size literals such as ``10MB``."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# No limit: the largest number of bytes.
NO_LIMIT = (1 << 63) - 1
_SIZE = r"^(\d+(?:\.\d+)?)\s*(B|KB|K|MB|M|GB|G)?\z"
_POWERS = {"K": 1, "M": 2, "G": 3}


def parse_byte_size(value: str | int | float | None) -> int:
    """Bytes meant by a size literal (none: no limit); raises ``ValueError`` unless positive."""
    if value is None:
        return NO_LIMIT
    if isinstance(value, (int, float)):
        size = float(value)
    else:
        m = re.match(_SIZE.replace(r"\z", r"\Z"), value.strip().upper())
        size = float(m[1]) * 1024 ** _POWERS.get((m[2] or "B")[0], 0) if m else 0.0
    if not math.isfinite(size) or math.floor(size) <= 0:
        raise ValueError(f"Invalid max file size: {value!r}. Examples: 5MB, 500KB, 10485760")
    return math.floor(size)


def byte_size(text: Column) -> Column:
    """Column form of :func:`parse_byte_size`; null when the literal is not valid."""
    clean = F.upper(F.btrim(text, F.lit(" \t\n\r")))
    number = F.regexp_extract(clean, _SIZE, 1).try_cast("double")
    unit = F.left(F.regexp_extract(clean, _SIZE, 2), F.lit(1))
    factor = F.lit(1.0)
    for letter, power in _POWERS.items():
        factor = F.when(unit == letter, float(1024 ** power)).otherwise(factor)
    size = F.floor(number * factor)
    return F.when(size > 0, size)
