"""Python helpers over Arrow batches, a bounded piece of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

# A piece has at most so many rows, and so many bytes unless it is one row.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 18


def pieces(arrays: tuple[pa.Array, ...], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of arrays of one length, in order, none above the limits unless it is one row."""
    todo = [arrays]
    while todo:
        part = todo.pop()
        n = len(part[0])
        if n > 1 and (n > rows or sum(a.nbytes for a in part) > size):
            todo += [tuple(a.slice(n // 2) for a in part), tuple(a.slice(0, n // 2) for a in part)]
        elif n:
            yield part


def results(one: Callable, batches, target: pa.DataType) -> Iterator[pa.Array]:
    """``one`` of the values of each row of the batches, an array per piece."""
    for batch in batches:
        for part in pieces(batch if isinstance(batch, tuple) else (batch,)):
            yield pa.array([one(*values) for values in zip(*(a.to_pylist() for a in part))], target)


def by_row(one: Callable, ddl: str, column: Column, deterministic: bool = True) -> Column:
    """``one`` of the value of each row, in a batched helper.

    An Arrow batch has up to ten thousand rows, and the Python objects made of them take many times its bytes. Here only
    a piece of it is Python objects at any time, and its results leave the worker before the next piece is taken.
    """
    target = to_arrow_type(DataType.fromDDL(ddl))

    def helper(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return results(one, batches, target)

    made = F.arrow_udf(helper, ddl)
    return (made if deterministic else made.asNondeterministic())(column)
