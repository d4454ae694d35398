"""Token-id files: ids in plane-shuffled, compressed chunks with an index.

A data set of token ids is a folder of Parquet files, one for each range of
documents in ascending order. A row is a chunk of ``CHUNK`` ids (a file's last
chunk may have fewer): the ids, transposed into byte planes or bit planes, each
plane compressed by zstandard, behind a small header. Beside its payload a
chunk has its place in the file and the runs of documents that it holds, which
are the index: readers prune the payload column to read the index alone.

Payload: b"PLN1", then unsigned little-endian 32-bit numbers: the number of ids,
the kind (8: byte planes, 1: bit planes), the number of planes, the compressed
size of each plane; then the planes, lowest first. Planes above the largest id
are left out.

Order: rows are dealt by range of (document id, text hash) and sorted, so one
document id on very many rows doesn't make one large file. Null ids come first,
null and empty texts give the end id alone; each row is a document of its own;
rows that share an id follow each other by text hash. Very long texts are cut into as
many chunks as they fill. An empty table gives an empty folder, which reads as no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Table, tokenizer
from .common import partitions, ship, take_runs

CHUNK = 65_536
MAGIC = b"PLN1"
#: Documents that are encoded together.
TOGETHER = 2_000
#: Stretches that a process keeps encoded; the table is begun anew beyond it.
TABLE_WORDS = 690_000

_CHUNKS = pa.schema([("file", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_no", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("payload", pa.binary())])
_CHUNKS_SQL = "file int, chunk int, first long, n_ids int, doc_no array<long>, doc_id array<long>, at array<long>, n array<int>, payload binary"


def pack_chunk(ids: np.ndarray, kind: int = 8, level: int = 3) -> bytes:
    """One chunk's payload."""
    v = np.ascontiguousarray(ids, "<u4")
    bits = int(v.max()).bit_length() if len(v) else 0
    if kind == 8:
        planes = v.view(np.uint8).reshape(-1, 4).T[: (bits + 7) // 8]
    else:
        planes = [np.packbits((v >> np.uint32(b)) & np.uint32(1) != 0) for b in range(bits)]
    z = zstandard.ZstdCompressor(level=level)
    packed = [z.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    head = np.array([len(v), kind, len(packed), *map(len, packed)], "<u4")
    return b"".join([MAGIC, head.tobytes(), *packed])


def unpack_chunk(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n, kind, count = np.frombuffer(payload, "<u4", 3, 4).tolist()
    sizes = np.frombuffer(payload, "<u4", count, 16).tolist()
    at, z = 16 + 4 * count, zstandard.ZstdDecompressor()
    out = np.zeros((n, 4), np.uint8) if kind == 8 else np.zeros(n, "<u4")
    for k, size in enumerate(sizes):
        plane = np.frombuffer(z.decompress(payload[at : at + size]), np.uint8)
        if kind == 8:
            out[:, k] = plane
        else:
            out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)
        at += size
    return out.view("<u4").ravel() if kind == 8 else out


class WordCache:
    """Ids of stretches between white space, whose words the library has encoded, while the table holds them.

    No word crosses white space, so a stretch's ids are those of its words; white
    space beyond ASCII within a stretch is the tokenizer's own matter.
    """

    def __init__(self, path: str) -> None:
        self.tok, self.stretches = tokenizer(path), Table()

    def encode(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The stretches' ids in a row, and how many each has."""
        coded = stretches.dictionary_encode()
        own = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        n = self.stretches.lengths[own]
        return self.stretches.ids[take_runs(self.stretches.starts[own], n)], n

    def _numbers(self, stretches: list[str]) -> np.ndarray:
        if len(self.stretches.at) > TABLE_WORDS:
            self.stretches = Table()
        at = self.stretches.find(stretches)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            missing, new, words, counts = self.tok.words_of_missing(stretches, missing)
            each = dict(zip(dict.fromkeys(words), count()))
            flat, n = self.tok.encode_flat(list(each))
            own = np.fromiter(map(each.__getitem__, words), np.int64, len(words))
            ends = np.concatenate([[0], np.cumsum(n[own])])[np.concatenate([[0], np.cumsum(counts)])]
            at[missing] = np.arange(len(self.stretches.at), len(self.stretches.at) + len(new))
            self.stretches.add(new, np.diff(ends), flat[take_runs((np.cumsum(n) - n)[own], n[own])])
        return at


def _encoded(cache: WordCache, batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids); many documents are split and looked up together."""
    for whole in batches:
        for k in range(0, len(whole), TOGETHER):
            batch = whole.slice(k, TOGETHER)
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
            ids, n = cache.encode(lists.flatten())
            at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                yield doc, np.append(ids[a:b], np.uint32(end_id))


_caches: dict[str, WordCache] = {}


def _chunks(path: str, end_id: int, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = _caches.setdefault(path, WordCache(path))
        file = TaskContext.get().partitionId()
        buf, held, first, chunk, no = [], 0, 0, 0, 0
        runs: list[tuple] = []  # document number, id, place in the document, ids

        def close() -> pa.RecordBatch:
            ids = np.concatenate(buf) if buf else np.zeros(0, np.uint32)
            cols = [list(c) for c in zip(*runs)] if runs else [[], [], [], []]
            row = [file, chunk, first, len(ids), *cols, pack_chunk(ids, kind)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHUNKS.types)], schema=_CHUNKS)

        for doc, ids in _encoded(cache, batches, end_id):
            at = 0
            while at < len(ids):
                own = ids[at : at + CHUNK - held]
                buf.append(own)
                runs.append((no, doc, at, len(own)))
                held, at = held + len(own), at + len(own)
                if held == CHUNK:
                    yield close()
                    first, chunk, held, buf, runs = first + CHUNK, chunk + 1, 0, [], []
            no += 1
        if runs:
            yield close()

    return run


def write(docs: DataFrame, out: str, path: str, end_id: int = 2, kind: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's text, add ``end_id`` and write the folder ``out``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_chunks(path, end_id, kind), _CHUNKS_SQL).write.option("compression", "uncompressed").parquet(out)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """(file, chunk, first, n_ids, ids_before): the chunks and the ids that stand before them in all files."""
    chunks = spark.read.parquet(out).select("file", "chunk", "first", "n_ids")
    return chunks.join(F.broadcast(_before(spark, out)), "file").withColumn("ids_before", F.col("before") + F.col("first")).drop("before")


def _before(spark: SparkSession, out: str) -> DataFrame:
    """(file, before): a row for each file of the data set, as many as the writer had partitions."""
    totals = spark.read.parquet(out).groupBy("file").agg(F.sum("n_ids").alias("own"))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("before"))


def _pieces(spark: SparkSession, out: str, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_chunk(row["payload"])
                raw = memoryview(ids.tobytes())
                ends = np.cumsum(row["n"]).tolist() if row["n"] else []
                starts = [0, *ends[:-1]]
                k = len(ends)
                cols = [
                    pa.array([row["file"]] * k, pa.int32()), pa.array(row["doc_no"], pa.int64()), pa.array(row["doc_id"], pa.int64()), pa.array(row["at"], pa.int64()),
                    pa.array([row["first"] + a for a in starts], pa.int64()), pa.array(row["n"], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                ]
                names = ["file", "doc_no", "doc_id", "at", "first", "n", "crc"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    chunks = spark.read.parquet(out).select("file", "first", "doc_no", "doc_id", "at", "n", "payload")
    return chunks.mapInArrow(run, "file int, doc_no long, doc_id long, at long, first long, n long, crc long" + ", ids array<int>" * with_ids)


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, end id included."""
    pieces = _pieces(spark, out, True).groupBy("file", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts")
    )
    joined = pieces.join(F.broadcast(_before(spark, out)), "file")
    return joined.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", F.flatten("parts.ids").alias("ids"))


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def crc32_concat(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings, one after the other, from their sums; length: bytes of the second.

    Appending a zero bit is a linear map over GF(2); its powers by repeated
    squaring move the first sum past ``length`` bytes.
    """
    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):  # one zero byte
        step = [_times(step, x) for x in step]
    while length:
        if length & 1:
            a = _times(step, a)
        length >>= 1
        if length:
            step = [_times(step, x) for x in step]
    return a ^ b


def digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files.

    A document's sum is made from the sums of its pieces, so even a document of
    very many chunks is never gathered.
    """
    ship(spark)
    pieces = _pieces(spark, out, False).join(F.broadcast(_before(spark, out)), "file")
    dealt = pieces.repartition(partitions(spark), "file", "doc_no").sortWithinPartitions("file", "doc_no", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if (r["file"], r["doc_no"]) == key:
                    now = (now[0], now[1], now[2] + r["n"], crc32_concat(now[3], r["crc"], 4 * r["n"]))
                else:
                    if key:
                        rows.append(now)
                    key, now = (r["file"], r["doc_no"]), (r["doc_id"], r["before"] + r["first"], r["n"], r["crc"])
            if rows:
                yield _done(rows)
        if key:
            yield _done([now])

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _done(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
