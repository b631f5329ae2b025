"""Token estimates and budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERAL = re.compile(r"(\d+)([kKmM]?)")
_UNIT = {"": 1, "k": 1_000, "m": 1_000_000}
_MOST = 2**63 - 1


def ceil_div(n: int, d: int) -> int:
    return -(-n // d)


def estimate(n_bytes: Column) -> Column:
    """A token for each 4 bytes begun, 1 at least."""
    return F.greatest(F.lit(1), F.shiftright(n_bytes.cast("bigint") + 3, 2)).cast("bigint")


def estimate_of(n_bytes: int) -> int:
    return max(1, ceil_div(n_bytes, 4))


def split_budget(total: int) -> tuple[int, int]:
    """(for metadata, for excerpts): a tenth, rounded up, and the rest."""
    metadata = ceil_div(total, 10)
    return metadata, total - metadata


def metadata_estimate(languages: int, files: int, focuses: int, reserved: int) -> int:
    return min(128 + 16 * languages + 24 * files + 16 * focuses, reserved)


def parse_budget(literal: str | int) -> int:
    """'128000', '128k' or '2m' as a number of tokens; ValueError for anything else, or 0."""
    m = _LITERAL.fullmatch(str(literal).strip())
    if not m:
        raise ValueError(f"not a token budget: {literal!r}")
    value = int(m[1]) * _UNIT[m[2].lower()]
    if not 0 < value <= _MOST:
        raise ValueError(f"a token budget must be more than 0 and below 2^63: {literal!r}")
    return value
