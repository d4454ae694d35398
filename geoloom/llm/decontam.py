"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words under a fixed mask; the mask's zeros stand for
words that may differ, so a passage with replaced words still shares seeds with
its source. The masks below leave at least one seed whole in any twelve aligned
words of which two differ. Items shorter than ``SHORT`` words have masks of their
own: each leaves out as many of the item's words as may differ.

1. Seeds of the benchmark are made once. A Bloom filter over them, of a size
   that is bounded whatever the benchmark's, goes to every task.
2. One pass over the documents returns the places whose seeds pass the filter.
3. They are joined with the benchmark's seeds on the hash. A hit gives
   (document, item, diagonal); repeated hits on a diagonal collapse.
4. Each diagonal is verified word by word on the whole document and the whole item:
   an overlap is the longest stretch of at least ``min_words`` aligned words (or the
   whole item, if shorter) of which the share ``min_share`` or more agrees. A
   document's candidates come to its text in one stream.

Defined results: null and empty texts, and items without words, overlap with
nothing. Rows that share an id each yield their overlaps, and the best one of each
(id, item) is returned; ties go to the most agreeing words, then to the first place
in the document, then in the item. Null ids of documents and items are ids like any
other. Very long texts and overlaps are worked on whole. An empty table on either
side gives no rows. Other columns, whatever their names, are ignored, or pass
through :func:`apply`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, ship, table
from .words import alnum_words, flat, gram_hash, hashed

#: Fixed masks; 1: the word counts, 0: any word may stand there.
MASKS = ("111111", "11101011", "110011011", "11010111", "1111001001")
MIN_WORDS = 12
MIN_SHARE = 0.8
#: Items of fewer words have masks of their own length.
SHORT = 12
#: The Bloom filter's bits: 256 a seed within these bounds.
BITS = (16, 28)
#: Bits of the filter that one task fills and the driver receives as one row.
BLOCK_BITS = 20
#: Seeds of the benchmark up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_SEEDS = 200_000

#: (offsets of the words that count, the length of the items it is for or 0 for all)
Mask = tuple[tuple[int, ...], int]


def masks_for(lengths: list[int], min_share: float = MIN_SHARE) -> list[Mask]:
    """The fixed masks, and for each short length those that leave out the words that may differ."""
    out: list[Mask] = [(tuple(k for k, c in enumerate(m) if c == "1"), 0) for m in MASKS]
    for n in sorted(lengths):
        may = min(n - 1, int((1 - min_share) * n + 1e-9))
        out += [(tuple(k for k in range(n) if k not in gone), n) for gone in combinations(range(n), may)]
    return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [hashed(alnum_words(t)).view(np.int64) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int64()))], ["item", "ik", "item_words"])


def _seeds(masks: list[Mask]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, ik, words in zip(*batch.columns):
                own = words.values.to_numpy().view(np.uint64) if len(words) else np.zeros(0, np.uint64)
                seeds = [gram_hash(own, o, s) if n in (0, len(own)) else own[:0] for s, (o, n) in enumerate(masks)]
                pos = np.concatenate([np.arange(len(x)) for x in seeds])
                k = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * k, pa.int64()), pa.array([ik.as_py()] * k, pa.int64()), pa.array(pos, pa.int64()), pa.array(np.concatenate(seeds).view(np.int64))], ["item", "ik", "pos", "seed"])

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bit) in order of block to (block, its bits)."""
    block, own = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["block", "bits"])
    for batch in batches:
        at, bits = (c.to_numpy() for c in batch.columns)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if at[a] != block:
                if own is not None:
                    yield done()
                block, own = int(at[a]), np.zeros(1 << (BLOCK_BITS - 6), np.uint64)
            bit = (bits[a:b] & ((1 << BLOCK_BITS) - 1)).astype(np.uint64)
            np.bitwise_or.at(own, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    if own is not None:
        yield done()


def _filter(seeds: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """The Bloom filter's bits and words; the driver receives as many bytes as it has, at most 32 MB."""
    bits = min(max(BITS[0], (256 * count).bit_length()), BITS[1])
    low = (1 << bits) - 1
    places = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", 32).bitwiseAND(low))).alias("bit"))
    dealt = places.select(F.shiftright("bit", BLOCK_BITS).alias("block"), "bit").repartition(partitions(seeds.sparkSession), "block").sortWithinPartitions("block")
    words = np.zeros(max(1, 1 << (bits - BLOCK_BITS) if bits > BLOCK_BITS else 1) << (BLOCK_BITS - 6), np.uint64)
    for row in dealt.mapInArrow(_fill, "block long, bits binary").toLocalIterator():
        at = row.block << (BLOCK_BITS - 6)
        words[at : at + (1 << (BLOCK_BITS - 6))] = np.frombuffer(row.bits, np.uint64)
    return bits, words


def _places(masks: list[Mask], bits: int, sent):
    """(doc, th, at, seed) of the places whose seeds pass the filter."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value

        def passes(h: np.ndarray) -> np.ndarray:
            a = h & mask
            ok = np.flatnonzero((filled[a >> np.uint64(6)] >> (a & np.uint64(63))) & np.uint64(1))
            b = (h[ok] >> np.uint64(32)) & mask
            return ok[((filled[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)) != 0]

        for rows, batch, h, ends in flat(batches, alnum_words):
            for s, (offsets, _) in enumerate(masks):
                g = gram_hash(h, offsets, s)
                ok = passes(g)
                row = np.searchsorted(ends, ok, side="right") - 1
                inside = ok + offsets[-1] < ends[row + 1]
                ok, row = ok[inside], row[inside]
                if len(ok):
                    own = pa.array(np.array(rows)[row])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(ok - ends[row]), pa.array(g[ok].view(np.int64))], ["doc", "th", "at", "seed"])

    return run


def _best(same: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch of which the share agrees, as (start, end); of equal ones the one that agrees most, then the first.

    With +1-share for a match and -share for a difference a stretch qualifies
    iff its sum is not negative: the widest pair of rising prefix sums.
    """
    p = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - share, -share))])
    low = np.minimum.accumulate(p)
    best = 0
    for end in range(len(p) - 1, 0, -1):
        if end <= best:
            break
        best = max(best, end - int(np.searchsorted(-low, -(p[end] + 1e-9))))
    ups = np.concatenate([[0], np.cumsum(same)])
    at = int(np.argmax(ups[best:] - ups[: len(ups) - best]))
    return at, at + best


def _verify(min_words: int, min_share: float):
    """A text, then its candidates; rows in order of (doc, th, role)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = None, None
        for batch in batches:
            out: list[tuple] = []
            for doc, th, role, text, item, item_words, d in zip(*batch.columns):
                own = (doc.as_py(), th.as_py())
                if role.as_py() == 0:
                    if own != key:
                        key, words = own, hashed(alnum_words(text.as_py())).view(np.int64)
                    continue
                d, b = d.as_py(), item_words.values.to_numpy()
                lo, hi = max(0, -d), min(len(b), len(words) - d)
                same = words[lo + d : hi + d] == b[lo:hi]
                x, y = _best(same, min_share)
                if y > x and y - x >= min(min_words, len(b)):
                    out.append((own[0], item.as_py(), d + lo + x, lo + x, y - x, int(same[x:y].sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_same): the longest overlap of each pair that has one."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).select("item", F.xxhash64("text").alias("ik"), "text")
    bench = table(items.mapInArrow(_item_words, "item long, ik long, item_words array<long>"))
    lengths = [r[0] for r in bench.select(F.size("item_words").alias("n")).filter(f"n > 0 and n < {SHORT}").distinct().collect()]  # at most SHORT numbers
    masks = masks_for(lengths, min_share)
    seeds = table(bench.mapInArrow(_seeds(masks), "item long, ik long, pos long, seed long"))
    count = seeds.count()
    bits, filled = _filter(seeds, count)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    places = rows.mapInArrow(released(_places(masks, bits, spark.sparkContext.broadcast(filled))), "doc long, th long, at long, seed long")
    small = F.broadcast if count <= BROADCAST_SEEDS else (lambda df: df)
    found = table(places.join(small(seeds), "seed").select("doc", "th", "item", "ik", (F.col("at") - F.col("pos")).alias("d")).distinct())
    held = found.select(F.col("doc").alias("d2"), F.col("th").alias("t2")).distinct()
    texts = rows.join(held, rows.doc.eqNullSafe(held.d2) & (rows.th == held.t2), "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    heads = texts.select("doc", "th", F.lit(0).alias("role"), "text", none("long").alias("item"), none("array<long>").alias("item_words"), none("long").alias("d"))
    words = bench.select("ik", "item_words").dropDuplicates(["ik"])
    tried = found.join(small(words), "ik").select("doc", "th", F.lit(1).alias("role"), none("string").alias("text"), "item", "item_words", "d")
    dealt = heads.union(tried).repartition(partitions(spark), "doc", "th").sortWithinPartitions("doc", "th", "role")
    checked = dealt.mapInArrow(released(_verify(min_words, min_share)), "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_same long")
    best = F.max(F.struct("n_words", "n_same", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"), "b.n_words", "b.n_same")


def apply(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap with any benchmark item."""
    found = overlaps(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__gl_doc")).distinct()
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__gl_doc")), "left_anti")
