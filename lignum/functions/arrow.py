"""Batches of Arrow, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

ROWS, BYTES = 256, 4 << 20


def in_pieces(batches: Iterator[tuple[pa.Array, ...]], of: Callable[..., Any], kind: pa.DataType, sized: int = 0) -> Iterator[pa.Array]:
    """`of` each row, handed on a few rows at a time, so that a worker holds no more than the batch itself and a piece of it.

    A piece ends at ROWS rows, or once its values of column `sized` have BYTES.
    """
    for columns in batches:
        out: list[Any] = []
        size = 0
        for row in zip(*columns):
            values = [x.as_py() for x in row]
            size += len(values[sized] or b"")
            out.append(of(*values))
            if len(out) >= ROWS or size >= BYTES:
                yield pa.array(out, kind)
                out, size = [], 0
        if out:
            yield pa.array(out, kind)
