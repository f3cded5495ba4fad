"""Pieces shared by the operators of this subpackage: word splitting and hashing
over Arrow buffers, and packing of arrays.

Spark cuts what it hands to Python into batches by bytes
(spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless the cluster says
otherwise), and `text_slices` cuts those again, so a worker's memory doesn't
depend on how many long texts stand together. Texts go in smaller batches still,
by the settings of a session beside the caller's (`in_small_batches`), as no
operator changes a setting of the caller's session.

A word is a maximal run of bytes other than space and \\x09-\\x0D, the same
definition in numpy (`word_spans`), in Spark SQL and in DuckDB (`WORD`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.fixpoint import connected_components as connected_components
from ..plans.storage import discard as discard
from ..plans.storage import materialize as materialize
from ..plans.storage import shared_dir

#: A word as a regular expression, for Java and for RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def in_small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """The same frame in a session of its own, with the settings of its session but for the rows of an Arrow batch.

    A global temporary view, which goes at once, hands the plan over. The frames of
    both sessions can be joined; where the caller's session runs the plan, batches
    are as large as it says, and results are the same.
    """
    spark = df.sparkSession
    beside, name = spark.newSession(), f"handed_over_{uuid.uuid4().hex}"
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    beside.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.createGlobalTempView(name)
    try:
        return beside.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (one more entry at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time for all spans together."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 8,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix64((length.astype(np.uint64) + np.uint64(1)) * _M1)
    rows, done = np.arange(len(starts)), 0
    while len(rows):
        take = np.minimum(length[rows] - done, 8)
        h[rows] = mix64((h[rows] ^ (eight[starts[rows] + done] & _LOW_BYTES[take])) * _M1)
        done += 8
        rows = rows[length[rows] > done]
    return h


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows holding at most `most` bytes together; a longer row is a run of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = end


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of each batch with about `most` bytes of text: the slice, its bytes and its offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        for a, b in row_slices(offsets, most):
            part = batch.slice(a, b - a)
            yield part, *text_bytes(part.column(column))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes under zstd: high bytes of small numbers all but vanish."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    planes, out, at = np.frombuffer(pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out
