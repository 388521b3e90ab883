"""Shared helpers: word and character hashes of a text, Arrow maps, and a per-worker store.

Hashes are 64-bit and vectorized: a prefix sum of ``table[byte] * base**position`` gives the hash of
every span of a text by one subtraction, so words and shingles cost no Python call each.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker (helpers travel by value, so their module globals don't)."""
    module = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store"))
    return module.__dict__.setdefault(name, {})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept in the worker."""
    store = worker_store("powers")
    if store.get("n", 0) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        base = 0xD6E8FEB86659FD93
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, base, _U)]))
            down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, pow(base, -1, 1 << 64), _U)]))
        store.update(n=size, up=up, down=down)
    return store["up"], store["down"]


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``symbols[start:end]`` for each span; equal spans hash alike wherever they lie."""
    up, down = _powers(len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, _U)
    np.cumsum(symbols * up[: len(symbols)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def _blank_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


_BLANK = _blank_table()


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z lower-cased) and the starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, in bytes."""
    raw = np.frombuffer(data.lower(), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_BLANK[raw]
    edge = np.diff(inside)
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word of a text, in order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, _U)
    raw, starts, ends = word_spans(data)
    return span_hashes(_TABLE[raw], starts, ends)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words; of the whole sequence if it is shorter; empty if there are none."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, _U)
    for k in range(width):
        out += words[k : k + len(out)] * _U(pow(0xC2B2AE3D27D4EB4F, 2 * k + 1, 1 << 64))
    return mix(out + _U(width))


def sequence_hash(words: np.ndarray) -> int:
    """A signed 64-bit hash of a whole sequence of word hashes; 0 if there are none."""
    n = len(words)
    if not n:
        return 0
    total = (words * _powers(n + 1)[0][1 : n + 1]).sum(dtype=_U)
    return int(mix(np.array([total + _U(n)], _U)).view(np.int64)[0])


def char_shingles(text: str, width: int) -> np.ndarray:
    """The hash of every run of ``width`` code points; of the whole text if it is shorter."""
    if not text:
        return np.zeros(0, _U)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    n, width = len(points), min(width, len(points))
    starts = np.arange(n - width + 1)
    return span_hashes(mix(points + _U(1)), starts, starts + width)


def map_rows(df: DataFrame, make_rows, ddl: str, rows_per_batch: int = 2000) -> DataFrame:
    """``make_rows(iterator of tuples)`` yields tuples of the ``ddl``; runs per partition over Arrow batches.

    The rows of a partition come in order and one at a time, so a helper holds one text at once.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    target = _arrow_schema(schema)

    def run(batches):
        out, held = [], 0
        for row in make_rows(_rows_of(batches)):
            out.append(row)
            held += sum(len(v) for v in row if isinstance(v, (str, bytes, list, np.ndarray)))
            if len(out) >= rows_per_batch or held > 4_000_000:
                yield _batch(out, target)
                out, held = [], 0
        if out:
            yield _batch(out, target)

    return df.mapInArrow(run, schema)


def map_arrays(df: DataFrame, make_arrays, ddl: str, rows_per_batch: int = 100_000) -> DataFrame:
    """As :func:`map_rows`, for many small rows: ``make_arrays`` yields one array per column, all of one length.

    Rows are put together from the arrays and are never Python objects.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    target = _arrow_schema(schema)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*held), target)], schema=target)

    def run(batches):
        held, n = [], 0
        for columns in make_arrays(_rows_of(batches)):
            held.append(columns)
            n += len(columns[0])
            if n >= rows_per_batch:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    return df.mapInArrow(run, schema)


def _rows_of(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # few Python objects at a time
            part = batch.slice(start, 256)
            yield from zip(*(column.to_pylist() for column in part.columns)) if part.num_columns else ()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
