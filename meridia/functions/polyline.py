"""Polyline codec (1e5 scaling, deltas, zig-zag, five-bit chunks) as Arrow functions on whole columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
BOX = T.StructType([T.StructField(c, T.LongType()) for c in ("min_x", "min_y", "max_x", "max_y")])


class PolylineError(ValueError):
    """empty input, invalid byte, overflow or an unterminated number."""


def round_half_away(x: float) -> int:
    return -math.floor(-x + 0.5) if x < 0 else math.floor(x + 0.5)


def encode_uint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x20:
        out.append((value & 0x1F) + 95)
        value >>= 5
    out.append(value + 63)
    return bytes(out)


def encode_int(value: int) -> bytes:
    return encode_uint((-value << 1) - 1 if value < 0 else value << 1)


def decode_uint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number and the position after it."""
    if at >= len(data):
        raise PolylineError("empty")
    value, shift = 0, 0
    while at < len(data):
        b = data[at]
        if not 63 <= b < 127:
            raise PolylineError("invalid byte")
        last = b < 95
        value |= (b - (63 if last else 95)) << shift
        if value >= 1 << 64:
            raise PolylineError("overflow")
        at, shift = at + 1, shift + 5
        if last:
            return value, at
    raise PolylineError("unterminated")


def decode_int(data: bytes, at: int = 0) -> tuple[int, int]:
    value, at = decode_uint(data, at)
    return (-((value + 1) >> 1) if value & 1 else value >> 1), at


def encode_ints(points: list[tuple[int, int]]) -> bytes:
    out, x, y = bytearray(), 0, 0
    for a, b in points:
        out += encode_int(a - x) + encode_int(b - y)
        x, y = a, b
    return bytes(out)


def encode_coords(points: list[tuple[float, float]]) -> bytes:
    return encode_ints([(round_half_away(a * 1e5), round_half_away(b * 1e5)) for a, b in points])


def decode_ints(data: bytes) -> list[tuple[int, int]]:
    """Exact scaled coordinates; values beyond 32 bits are an overflow."""
    out, at, x, y = [], 0, 0, 0
    while at < len(data):
        dx, at = decode_int(data, at)
        dy, at = decode_int(data, at)
        x, y = x + dx, y + dy
        if not (-(1 << 31) <= x < 1 << 31 and -(1 << 31) <= y < 1 << 31):
            raise PolylineError("overflow")
        out.append((x, y))
    return out


def decode_coords(data: bytes) -> list[tuple[float, float]]:
    return [(a / 1e5, b / 1e5) for a, b in decode_ints(data)]


# Whole columns: the bytes or numbers of all rows of an Arrow batch at once


def _lengths_to_ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _deltas(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Differences to the value before; a row's first is kept."""
    out = np.diff(values, prepend=0)
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    out[firsts] = values[firsts]
    return out


def encode_column(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each row's end; ends: where each row's points begin and end in x and y."""
    deltas = np.empty(2 * len(x), np.int64)
    deltas[0::2], deltas[1::2] = _deltas(x, ends), _deltas(y, ends)
    numbers = ((deltas << 1) ^ (deltas >> 63)).view(np.uint64)
    chunks = np.ones(len(numbers), np.int64)
    for shift in range(5, 64, 5):
        more = numbers >> np.uint64(shift) > 0
        if not more.any():
            break
        chunks += more
    at = _lengths_to_ends(chunks)
    out = np.empty(at[-1], np.uint8)
    for k in range(int(chunks.max(initial=0))):
        own = np.flatnonzero(chunks > k)
        last = chunks[own] == k + 1
        out[at[own] + k] = ((numbers[own] >> np.uint64(5 * k)) & np.uint64(31)).astype(np.uint8) + np.where(last, 63, 95).astype(np.uint8)
    return out, at[2 * ends]


def decode_column(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and where each row's points begin and end; ends: where each row's bytes do.  The first error in the bytes is raised by name."""
    faults: list[tuple[int, str]] = []

    def fault(where: np.ndarray, name: str) -> None:
        if len(where):
            faults.append((int(where[0]), name))

    fault(np.flatnonzero((data < 63) | (data >= 127)), "invalid byte")
    last = data < 95
    full = ends[:-1] < ends[1:]
    fault((ends[1:] - 1)[full & ~last[np.maximum(ends[1:] - 1, 0)]] if len(data) else ends[:0], "unterminated")
    stops = np.flatnonzero(last)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    size = stops - begins + 1
    fault(stops[size > 13], "overflow")
    per_row = _lengths_to_ends(np.diff(np.searchsorted(stops, ends)))
    fault(ends[1:][np.diff(per_row) % 2 == 1], "empty")
    if faults:
        raise PolylineError(min(faults)[1])
    chunk = np.arange(len(data)) - np.repeat(begins, size)
    top = (chunk == 12) & ((data - np.where(last, 63, 95)) > 15)
    if top.any():
        raise PolylineError("overflow")
    parts = (data - np.where(last, 63, 95)).astype(np.uint64) << (5 * chunk).astype(np.uint64)
    numbers = np.add.reduceat(parts, begins) if len(begins) else parts
    deltas = ((numbers >> np.uint64(1)) ^ (np.uint64(0) - (numbers & np.uint64(1)))).view(np.int64)
    points = per_row // 2
    out = []
    for part in (deltas[0::2], deltas[1::2]):
        run = np.concatenate([[0], np.cumsum(part)])
        value = run[1:] - np.repeat(run[points[:-1]], np.diff(points))
        if len(value) and (value.min() < -(1 << 31) or value.max() >= 1 << 31):
            raise PolylineError("overflow")
        out.append(value)
    return out[0], out[1], points


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each row's begin and end; a null row has none."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)), ends - ends[0]


def _nulls_of(column: pa.Array) -> pa.Buffer | None:
    return pa.array(column.is_valid()).buffers()[1] if column.null_count else None


@F.arrow_udf(T.BinaryType())
def encode_points(points: pa.Array) -> pa.Array:
    """array<struct<x,y>> of scaled coordinates to polyline bytes."""
    flat = points.flatten()
    ends = _lengths_to_ends(points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    x, y = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    data, at = encode_column(x, y, ends)
    return pa.Array.from_buffers(pa.large_binary(), len(points), [_nulls_of(points), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


@F.arrow_udf(POINTS)
def decode_points(data: pa.Array) -> pa.Array:
    x, y, ends = decode_column(*_bytes_of(data))
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])
    offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.r_[~data.is_valid().to_numpy(zero_copy_only=False), False] if data.null_count else None)
    return pa.ListArray.from_arrays(offsets, values)


@F.arrow_udf(BOX)
def points_box(data: pa.Array) -> pa.Array:
    """Box of the points in polyline bytes, from running sums of their differences: no point is made.  Null for no points."""
    x, y, ends = decode_column(*_bytes_of(data))
    full = ends[:-1] < ends[1:]
    at, out = ends[:-1][full], []
    for values, least in ((x, True), (y, True), (x, False), (y, False)):
        own = np.zeros(len(full), np.int64)
        if len(at):
            own[full] = (np.minimum if least else np.maximum).reduceat(values, at)
        out.append(pa.array(own))
    return pa.StructArray.from_arrays(out, ["min_x", "min_y", "max_x", "max_y"], mask=pa.array(~full))
