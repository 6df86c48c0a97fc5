"""Byte kernels as Arrow UDFs: whole batches through numpy tables, without a loop over rows or bytes.

Catalyst has no function that maps a byte to several characters; nested replace
calls over a hex string cost a pass for each digit, and the string doubles on the
way. These pass over a batch's buffer once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DENSE, PACKED = "AGCT", "ACGT"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Bytes of a string or binary column, n + 1 offsets into them (from 0), and which rows are valid (None: all)."""
    wide = column.cast(pa.large_binary())
    valid = np.array(column.is_valid()) if column.null_count else None
    if valid is not None:
        wide = wide.fill_null(b"")
    _, off, data = wide.buffers()
    bounds = np.frombuffer(off, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0], valid


def column_of(data: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    """The reverse: a string or binary column."""
    wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}[kind]
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    made = pa.Array.from_buffers(wide, len(bounds) - 1, [mask, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(kind)


def mapped(name: str, kind: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple]) -> Callable[[Column], Column]:
    """A column function from fn(bytes, bounds, valid) to the same of the result."""
    arrow = {"string": pa.string(), "binary": pa.binary()}[kind]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for rows in sliced(column):
                yield column_of(*fn(*flat(rows)), arrow)

    run.__name__ = name
    return F.arrow_udf(run, kind)


#: Bytes of a column that a kernel takes at a time, one row at least: results are up to eight times as large.
PART = 1 << 20


def sliced(column: pa.Array) -> Iterator[pa.Array]:
    """column in consecutive pieces of about PART bytes; an empty one as it is."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        yield column.slice(at, upto - at)
        at = upto
    if not len(column):
        yield column


def _spread(codes: np.ndarray) -> Callable:
    """Each byte as a row of codes (256, width)."""
    width = codes.shape[1]
    return lambda data, bounds, valid: (codes[data].reshape(-1), bounds * width, valid)


def _gathered(codes: np.ndarray, width: int) -> Callable:
    """width letters as one byte, big-endian; codes: bits of each letter, 255 for others. Null where a row isn't whole bytes of such letters."""
    bits = 8 // width

    def run(data: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None) -> tuple:
        digit = codes[data]
        good = np.diff(bounds) % width == 0
        bad = np.flatnonzero(digit == 255)
        good[np.searchsorted(bounds, bad, "right") - 1] = False
        if valid is not None:
            good &= valid
        size = np.where(good, np.diff(bounds), 0)
        if not good.all():
            digit = digit[np.repeat(good, np.diff(bounds))]
        packed = np.zeros(len(digit) // width, np.uint8)
        for k in range(width):
            packed |= digit[k::width] << np.uint8(bits * (width - 1 - k))
        return packed, np.concatenate(([0], np.cumsum(size // width))), good

    return run


def _letters(alphabet: str, width: int) -> np.ndarray:
    """For every byte, its letters."""
    bits = 8 // width
    value = np.arange(256)[:, None] >> (bits * np.arange(width - 1, -1, -1))[None, :]
    return np.frombuffer(alphabet.encode(), np.uint8)[value & ((1 << bits) - 1)]


def _codes(alphabet: str) -> np.ndarray:
    table = np.full(256, 255, np.uint8)
    table[list(alphabet.encode())] = range(len(alphabet))
    return table


def bits_of_letters(zero: str, one: str) -> np.ndarray:
    """For every byte, 1 if it is a letter of `one`, else 0."""
    table = np.zeros(256, np.uint8)
    table[list(zero.encode())], table[list(one.encode())] = 0, 1
    return table


def bytes_to_dna(content: Column, order: str = DENSE) -> Column:
    """Four bases a byte, big-endian; order has the bases of 00, 01, 10, 11."""
    return mapped("bytes_to_dna", "string", _spread(_letters(order, 4)))(content)


def dna_to_bytes(dna: Column, order: str = DENSE) -> Column:
    """Null if the strand isn't whole bytes of ACGT."""
    return mapped("dna_to_bytes", "binary", _gathered(_codes(order), 4))(dna)


def bytes_to_bits(content: Column) -> Column:
    """Big-endian bits of bytes."""
    return mapped("bytes_to_bits", "string", _spread(_letters("01", 8)))(content)


def bits_to_bytes(bits: Column) -> Column:
    """Bytes of a bit string whose length is a multiple of eight; null for others."""
    return mapped("bits_to_bytes", "binary", _gathered(_codes("01"), 8))(bits)
