"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. A document's set has the 64-bit hashes of its distinct word shingles (of all
   words, if they are fewer). One pass makes its size, a 128-bit hash of the whole
   set and a SuperMinHash signature: each element gets a random permutation of the
   slots and a rank for each; elements work level by level, and the work stops
   when no later level can lower a slot. The signature is cut into bands.
2. Documents with equal sets collapse into classes, counted with map-side
   combining; from here on only one representative of each is worked on.
3. Representatives that share a band are candidates. A bucket's smallest member is
   its pivot; the buckets of one pivot are one group, and every member is paired
   with the pivot once, however many bands they share.
4. These pairs are verified on their full sets, the texts dealt by (pivot, chunk),
   so a pivot with very many members is spread over tasks. Links become components
   by parallel union-find.
5. Groups that did not become one component are finished exactly by :func:`_rest`:
   blocks of bounded size compare, on full sets, what lies outside a group's main
   component with all else in the group, and return only the links that unite.
6. Links become components again.

No pair of a group is ever a row but those with its pivot, and a block returns
fewer rows than it reads.

Bands: with B bands of ``ROWS`` rows a pair at similarity s is missed with
probability (1 - s^ROWS)^B. B follows from the threshold, so that a pair at it is
missed with a probability under ``MISS``: 25 bands for 0.85, 37 for 0.80.

Defined results: a document without words has no shingles and links with nothing.
A null id is reported with a null component and kept. Rows that share an id are
one document whose row sets are compared one by one; each row has its own
``n_shingles``. Ties (equal sets) go to the smallest id. Very long texts are worked
on whole. An empty table gives no rows. Other columns, whatever their names, are
ignored, or pass through :func:`apply`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, released, ship, table
from .components import components
from .words import blank_words, flat, gram_hash, hashed

SHINGLE = 5
ROWS = 5
#: The most probable a pair at the threshold is missed.
MISS = 5e-7
#: Members that one task compares with a pivot.
CHUNK = 256
#: Members of a side of a block, and the shingles that they have together.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Shingles that a block counts at once.
SLAB = 2_048
#: Similarity, in hundredths.
PERCENT = 80


def shingle_set(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of hashed words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return gram_hash(words, tuple(range(len(words))), 100 + len(words))
    return np.unique(gram_hash(words, tuple(range(k)), 0))


def superminhash(elements: np.ndarray, slots: int) -> np.ndarray:
    """The signature of a set of 64-bit hashes: level in the high and rank in the low 32 bits of each slot."""
    sig = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    perm = None
    low = np.uint64(0xFFFFFFFF)
    for level in range(slots):
        x = mix64(elements ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF))
        at = level + ((((x & low) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64))
        if level == 0:
            slot, first = at, at
        else:
            if perm is None:  # what the first level has swapped
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                row = np.arange(len(elements))
                perm[row, first] = 0
                perm[:, 0] = first
            slot = perm[row, at].astype(np.int64)
            perm[row, at] = perm[:, level]
            perm[:, level] = slot
        np.minimum.at(sig, slot, (np.uint64(level) << np.uint64(32)) | (x >> np.uint64(32)))
        if int(sig.max()) < (level + 1) << 32:
            break
    return sig


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows that miss a pair at the threshold with a probability under ``MISS``."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(percent / 100, 0.999999) ** rows)))


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + sig[k * bands : (k + 1) * bands])
    return out.view(np.int64)


def _features(shingle: int, bands: int, rows: int):
    import xxhash

    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch, h, ends in flat(batches, blank_words):
            out: list[tuple] = []
            for k, a, b in zip(at, ends[:-1].tolist(), ends[1:].tolist()):
                own = shingle_set(h[a:b], shingle)
                key = xxhash.xxh3_128_digest(own.tobytes())
                band = band_hashes(superminhash(own, bands * rows), bands, rows) if len(own) else None
                out.append((batch.column(0)[k].as_py(), len(own), int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), band))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _compare(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            out: list[tuple] = []
            for a, chunk, role, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, chunk) != key:
                    key, heads = (a, chunk), []
                own = shingle_set(hashed(blank_words(text)), shingle)
                if role == 0:
                    heads.append(own)
                    continue
                for head in heads:
                    if len(head) and len(own):
                        both = len(np.intersect1d(head, own, assume_unique=True))
                        out.append((a, b, both, len(head) + len(own) - both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "shared", "either"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links among distinct pairs (a, b)."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(sizes, "a").select("a", F.expr("pmod(xxhash64(b), chunks)").cast("long").alias("chunk"), "b")
    heads = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("doc"))
    need = heads.union(dealt.select("a", "chunk", F.lit(1), "b"))
    rows = need.join(texts, "doc").select("a", "chunk", "role", "doc", "text")
    rows = rows.repartition(partitions(pairs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "role")
    done = rows.mapInArrow(released(_compare(shingle)), "a long, b long, shared long, either long")
    return table(done.filter(F.col("shared") * 100 >= F.col("either") * percent).select("a", "b"))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right."""
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, col, held = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    often = held[col] > 1  # what one set alone has is shared with none
    rows, col = rows[often], col[often]
    by = np.argsort(col, kind="stable")
    rows, col = rows[by], col[by]
    used = np.concatenate([[0], np.cumsum(np.diff(col) > 0)]) if len(col) else col
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(used[-1]) + 1 if len(used) else 0, SLAB):
        lo, hi = np.searchsorted(used, (k, k + SLAB))
        slab = np.zeros((len(left) + len(right), SLAB), np.float32)
        slab[rows[lo:hi], used[lo:hi] - k] = 1
        out += slab[: len(left)] @ slab[len(left) :].T
    return out.astype(np.int64)


def block_links(rows: list[tuple[int, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links of a block's rows (side, id, component, set) that unite components: all sides 0, or 0 with 1."""
    left = [r for r in rows if r[0] == 0 and len(r[3])]
    right = [r for r in rows if r[0] == 1 and len(r[3])] or left
    if not left:
        return []
    shared = _overlaps([r[3] for r in left], [r[3] for r in right])
    either = np.array([len(r[3]) for r in left])[:, None] + np.array([len(r[3]) for r in right]) - shared
    apart = np.array([r[2] for r in left])[:, None] != np.array([r[2] for r in right])
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero((shared * 100 >= either * percent) & apart))):
        a, b = root(left[i][2]), root(right[j][2])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((left[i][1], right[j][1]))
    return out


def _blocks(percent: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for g, lo, hi, side, doc, c, text in zip(*(x.to_pylist() for x in batch.columns)):
                if (g, lo, hi) != key:
                    out += block_links(rows, percent)
                    key, rows = (g, lo, hi), []
                rows.append((side, doc, c, shingle_set(hashed(blank_words(text)), shingle)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if out := block_links(rows, percent):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _unlike(texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(doc, th) of the rows that have so many shingles alone that they link with none of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch, h, ends in flat(batches, blank_words):
            sets = [shingle_set(h[a:b], shingle) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = np.array([len(x) for x in sets])
            cols = [np.repeat(np.array([batch.column(k)[i].as_py() for i in at], np.int64), n) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["doc", "th", "n", "s"])

    rows = texts.select("doc", "text", "th").mapInArrow(released(run), "doc long, th long, n long, s long")
    row = F.struct("doc", "th", "n")
    once = rows.groupBy("s").agg(F.min(row).alias("row"), F.max(row).alias("other")).filter("row = other")
    return once.groupBy("row").agg(F.count(F.lit(1)).alias("alone")).filter((F.col("row.n") - F.col("alone")) * 100 < F.col("row.n") * percent).select("row.doc", "row.th")


def _rest(pairs: DataFrame, texts: DataFrame, label: DataFrame, percent: int, shingle: int) -> DataFrame | None:
    """The links that the groups' pivots do not show; None if there can be none.

    pairs: (a, b, n) with the pivot a, all of which are verified. A group is left
    with its other members. Of those, the members outside its largest component
    (cut into chunks of bounded size) meet each other and, in further blocks, the
    chunks of that component. In groups larger than a block, rows that have too much
    alone to link with any other are left out first; the rest is compared exactly.
    """
    grouped = pairs.select(F.col("a").alias("g"), F.col("b").alias("doc"), "n").join(label.select(F.col("v").alias("doc"), "c"), "doc", "left")
    grouped = table(grouped.withColumn("c", F.coalesce("c", "doc")))
    kinds = grouped.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    most = F.max(F.struct("k", "n", "c"))
    split = kinds.groupBy("g").agg(most.alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    over = lambda k, n: F.ceil(F.greatest(k / F.lit(float(BLOCK)), n / F.lit(float(BLOCK_SHINGLES)))).cast("long")
    split = split.withColumn("whole", over(F.col("k"), F.col("n")) <= 1)
    xs, ys = over(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")), over(F.col("main.k"), F.col("main.n"))
    split = split.select("g", F.col("main.c").alias("main"), "whole", F.when(F.col("whole"), 1).otherwise(xs).alias("xs"), F.when(F.col("whole"), 0).otherwise(ys).alias("ys"))
    left = table(grouped.join(split, "g"))
    sizes = left.agg(F.count(F.lit(1)), F.count(F.when(~F.col("whole"), 1))).first()
    if not sizes[0]:
        return None
    if sizes[1]:
        crowd = texts.join(left.filter("not whole").select("doc").distinct(), "doc", "left_semi")
        texts = texts.join(_unlike(crowd, percent, shingle).withColumn("gone", F.lit(True)), ["doc", "th"], "left")
    else:
        texts = texts.withColumn("gone", F.lit(None).cast("boolean"))
    in_main = ~F.col("whole") & (F.col("c") == F.col("main"))
    own = F.when(in_main, F.col("xs") + F.expr("pmod(xxhash64(doc), ys)")).otherwise(F.expr("pmod(xxhash64(doc), xs)"))
    dealt = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_main, F.col("xs") - 1).otherwise(F.col("xs") + F.col("ys") - 1))))
    dealt = dealt.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "c", "whole")
    rows = dealt.join(texts, "doc").filter("whole or gone is null").select("g", "lo", "hi", "side", "doc", "c", "text")
    rows = rows.repartition(partitions(pairs.sparkSession), "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    return table(rows.mapInArrow(released(_blocks(percent, shingle)), "a long, b long"))


def groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", bands: int | None = None, band_rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    bands = bands or bands_for(percent, band_rows)
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    feats = table(rows.mapInArrow(released(_features(shingle, bands, band_rows)), "doc long, n long, k1 long, k2 long, bands array<long>"))
    named = feats.filter("n > 0 and doc is not null")
    classes = named.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first = classes.filter("copies > 1").select("k1", "k2", "rep")
    reps = named.join(first, ["k1", "k2"], "left").filter("rep is null or rep = doc").select(F.col("doc").alias("rep"), "n", "bands").dropDuplicates(["rep", "bands"])
    banded = table(reps.select("rep", "n", F.explode("bands").alias("key")))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).filter("size > 1")
    # merge joins at every size: AQE splits what is crowded, and nothing that grows is broadcast
    met = banded.join(buckets.select("key", "pivot").hint("merge"), "key").filter("rep <> pivot")
    pairs = table(met.groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n")))
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = rows.filter("doc is not null").join(members.hint("merge"), "doc", "left_semi").withColumn("th", F.xxhash64("text"))
    texts = table(texts.dropDuplicates(["doc", "th"]))
    links = _verified(pairs.select("a", "b"), texts, percent, shingle)
    label = components(links)
    more = _rest(pairs, texts, label, percent, shingle)
    if more is not None and more.limit(1).count():
        label = components(links.union(more))
    linked = named.join(label.select(F.col("v").alias("doc"), "c"), "doc").groupBy("k1", "k2").agg(F.min("c").alias("c"))
    final = classes.join(linked, ["k1", "k2"], "left").filter("copies > 1 or c is not null").select("k1", "k2", F.coalesce("c", "rep").alias("c"))
    out = feats.join(final, ["k1", "k2"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("c", "doc")).otherwise(F.col("doc")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def apply(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id."""
    drop = groups(docs, percent, shingle, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gl_doc")).distinct()
    return docs.join(drop, F.col(id_col).cast("long") == F.col("__gl_doc"), "left_anti")
