"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, table


#: Links up to which one task unites all of them; more go through rounds of steps.
ONE_TASK = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's links: a star for each set of them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    rows = [(v, root(v)) for v in up if root(v) != v]
    for k in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 50_000])], ["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c): every id that a link names, with the smallest id of its component.

    Each task first unites its own links. If few enough are left, one task unites
    them; else large-star and small-star steps alternate: every id hands its larger
    neighbours, then its smaller ones, to the smallest it knows, until all that is left
    are stars. The steps are aggregations with map-side combining and joins; rounds grow
    with the logarithm of the size.
    """
    ship(links.sparkSession)
    own = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    edges = table(own.mapInArrow(_contract, "a long, b long"))  # a > b
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.count_distinct("a").alias("d")).first()
        if now == state or now.n == 0:
            break
        if now.n <= ONE_TASK:
            edges = table(edges.coalesce(1).mapInArrow(_contract, "a long, b long"))
            break
        state = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = table(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("v"), F.col("b").alias("c")).union(edges.select(F.col("b").alias("v"), F.col("b").alias("c"))).distinct()
