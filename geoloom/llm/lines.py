"""Line dedup: repeated lines keep their place in one document only.

1. Every text is split into lines; a line's key (stripped, ASCII lower case, of
   ``min_chars`` code points or more) becomes a 128-bit hash.
2. The hashes are dealt by range of (hash, document descending, position), so a
   line that a third of all documents hold is cut into many even ranges, and
   each range is sorted by the same order.
3. Each task streams its range. The first document of a hash is its largest and
   keeps the line; from the third document on it is known that all others lose
   it. At most one document's lines wait in memory. For the few hashes that
   cross from one range into the next (at most one a range), counts made with
   map-side combining settle the matter.
4. The operator's result is a compressed bitmap of kept lines for each document
   that loses any; texts are not shuffled for it.

Defined results: a null or empty text is one empty line. A null document id is a
document below all others. Rows that share an id are one document: each row is
returned with the lines of its own text, and rows that repeat entirely get the
same result. Very long texts and lines are worked on whole. An empty table gives no
rows. Other columns, whatever their names, pass through :func:`apply`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, released, ship, table

STRIP = b" \t\n\x0b\x0c\r"
_TH = "__gl_text_hash"
_KEEP = "__gl_keep"


def _keys(min_chars: int):
    import xxhash

    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, text, th in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                lines = text.encode().lower().split(b"\n")
                for k, line in enumerate(lines):
                    key = line.strip(STRIP)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        h = xxhash.xxh3_128_digest(key)
                        rows.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), doc, th, k, len(lines)))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _stream(min_docs: int, settled: dict):
    """Rows to drop of a sorted range; settled: (count, largest document) of the hashes that cross ranges."""
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, first, last, wait = None, 0, None, None, []
        for batch in batches:
            h1, h2, docs, th, pos, n = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for k in range(len(docs)):
                own, doc = (h1[k], h2[k]), docs[k]
                if own != key:
                    key, seen, first, last, wait = own, 1, doc, doc, []
                    known = settled.get(own)
                if known is not None:
                    if known[0] >= min_docs and doc != known[1]:
                        out.append((doc, th[k], pos[k], n[k]))
                    continue
                if doc != last:
                    seen, last = seen + 1, doc
                if doc != first:
                    if seen >= min_docs:
                        out += wait
                        wait = []
                        out.append((doc, th[k], pos[k], n[k]))
                    else:
                        wait.append((doc, th[k], pos[k], n[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep binary) of the documents that lose lines.

    ``keep`` is a zlib-compressed bitmap with a bit for each line, first line
    first; a document without a row keeps all its lines. ``text_hash`` is
    Spark's xxhash64 of the text, so rows that share an id stay apart.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = table(rows.mapInArrow(released(_keys(min_chars)), "h1 long, h2 long, doc long, th long, pos int, n int"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last(), F.col("th"), F.col("pos")]
    dealt = cut(lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    # At most one row a range comes to the driver: the hashes at the ranges' ends.
    ends = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).orderBy("p").collect()
    shared = {tuple(b.lo) for a, b in zip(ends, ends[1:]) if a.hi == b.lo}
    settled = {}
    if shared:
        pairs = spark.createDataFrame(sorted(shared), "h1 long, h2 long")
        counted = dealt.join(F.broadcast(pairs), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc")).alias("docs"), F.max("doc").alias("largest"))
        settled = {(r.h1, r.h2): (r.docs, r.largest) for r in counted.collect()}
    drops = dealt.mapInArrow(_stream(min_docs, settled), "doc long, th long, pos int, n int")
    by_doc = drops.groupBy("doc", "th").agg(F.max("n").alias("n"), F.collect_set("pos").alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, maps = batch.column("n").to_pylist(), []
            for size, at in zip(n, batch.column("at")):
                bits = np.ones(size, np.uint8)
                bits[at.values.to_numpy()] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            dropped = pa.array([len(x) for x in batch.column("at")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(n, pa.int64()), dropped, pa.array(maps, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    return by_doc.mapInArrow(pack, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def _with_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    left = docs.withColumn(_TH, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    right = maps.select(F.col("doc_id").alias("__gl_doc"), F.col("text_hash").alias("__gl_th"), F.col("keep").alias(_KEEP))
    joined = left.join(right.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__gl_doc")) & (F.col(_TH) == F.col("__gl_th")), "left")
    return joined.select(*[left[f"`{c}`"] for c in docs.columns], right[_KEEP])


def _kept(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    left = [x for x, b in zip(lines, bits) if b]
    return "\n".join(left), len(lines), len(lines) - len(left)


def apply(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text's kept lines, and n_chars, if there, counted anew.

    A null text stays null. All rows stay, a text without lines left as "".
    """
    both = _with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(batch.num_columns - 1)
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            if keep.null_count < len(keep):
                text = cols[at].to_pylist()
                for k, m in enumerate(keep.to_pylist()):
                    if m is not None:
                        text[k] = _kept(text[k], m)[0]
                cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(cols, docs_names)

    docs_names = list(docs.columns)
    out = both.mapInArrow(released(run), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNotNull(), F.char_length(text_col)).cast(schema["n_chars"].dataType))
    return out.select(*docs_names)


def digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = _with_bitmaps(rows, keep_bitmaps(rows, min_chars, min_docs), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_kept(t, m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in done], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
