"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..runtime import cut, scratch, shared_dir, ship, table  # noqa: F401

#: ASCII white space, as the contracts define it.
ASCII_WS = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release() -> None:
    """Give freed memory back to the system: workers are used again and would keep it, each for itself."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def released(run: Callable) -> Callable:
    """A function for ``mapInArrow`` whose memory is given back once its task is done."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return go


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_u32(values: np.ndarray, level: int = 3) -> bytes:
    """Byte planes of unsigned 32-bit values, compressed together."""
    v = np.ascontiguousarray(values, dtype="<u4")
    planes = v.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unpack_u32(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_bytes(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack_bytes(blob: bytes) -> bytes:
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob)) as r:
        return r.read()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of uint64 (the splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def runs(offsets_of: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    out = np.zeros(len(offsets_of) + 1, np.int64)
    np.cumsum(offsets_of, out=out[1:])
    return out


def take_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out
