"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a bag of words, each weighted by its count w. For each sample a word has
two Gamma(2, 1) numbers r and c and a uniform number b, all drawn by hashing the
word. Then

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1),

and the sample is (word, t) where a is smallest. Two bags give the same sample with
a probability that equals their generalised Jaccard similarity, the sum of smaller
over the sum of larger weights; a fingerprint has ``SAMPLES`` samples of 16 bits,
and the likeness of two is the share of equal samples.

ln a and the sample's 16 bits are packed into one long, so a sample is a plain
minimum: words become rows once, counts and samples are hash aggregations that keep
the partitioning of the texts, and only texts and finished fingerprints are shuffled.
A counted word is repeated for each ``PART`` samples, so that the generated code stays
small however many samples there are.

Defined results: a null text counts as empty. A text without words has a fingerprint
of its own kind, like only to others without words. Ids are ordered with null below
all others and ties by text; rows that repeat entirely are one document in that
order and each get its result. A document alone is its own next. Very long texts are
worked on whole. An empty table gives no rows. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table
from .licenses import words

SAMPLES = 64
#: Samples that one aggregation row makes.
PART = 8
_NO_ID = -(2**63)


def _uniform(x: Column, bit: int) -> Column:
    """16 of a hash's bits as a number within (0, 1)."""
    return (F.shiftrightunsigned(x, bit).bitwiseAND(0xFFFF) + 0.5) * F.lit(1.0 / 65536)


def _sample(x: Column, y: Column, log_weight: Column) -> Column:
    """A word's packed rank and sample; x and y: two hashes of the word and the sample's number.

    A Gamma(2, 1) number is the negative logarithm of the product of two uniform ones.
    """
    r = -F.log(_uniform(x, 0) * _uniform(x, 16))
    log_c = F.log(-F.log(_uniform(x, 32) * _uniform(x, 48)))
    t = F.floor(log_weight / r + _uniform(y, 0))
    rank = ((log_c - r * (t - _uniform(y, 0) + 1.0) + 64.0) * float(1 << 32)).cast("long")
    bits = (F.shiftrightunsigned(y, 48) + t * 40503).bitwiseAND(0xFFFF)
    return F.shiftleft(rank, 16).bitwiseOR(bits)


def samples(counted: DataFrame, keys: list[str], sides: dict[str, str], n: int = SAMPLES) -> DataFrame:
    """keys and, for each side, an array of samples; counted has keys, ``h`` and each side's count column.

    sides: output name by count column. Rows whose count is null or 0 don't count for that side.
    """
    aggs, step = [], min(n, PART)
    for k in range(step):
        x, y = (F.xxhash64("h", F.lit(2 * k + i) + F.col("__part") * (2 * step)) for i in range(2))
        for name, count in sides.items():
            aggs.append(F.min(_sample(x, y, F.col(f"__log_{name}"))).alias(f"__{name}_{k}"))
    logged = counted.withColumns({f"__log_{name}": F.when(F.col(count) > 0, F.log(F.col(count).cast("double"))) for name, count in sides.items()})
    parts = logged.withColumn("__part", F.explode(F.array(*[F.lit(p) for p in range(-(-n // step))])))
    done = parts.groupBy(*keys, "__part").agg(*aggs)
    done = done.select(*keys, F.struct("__part", *[F.array(*[F.col(f"__{name}_{k}").bitwiseAND(0xFFFF).cast("int") for k in range(step)]).alias(name) for name in sides]).alias("__own"))
    whole = done.groupBy(*keys).agg(F.array_sort(F.collect_list("__own")).alias("__all"))
    return whole.select(*keys, *[F.slice(F.flatten(F.col(f"__all.{name}")), 1, n).alias(name) for name in sides])


def text_of(sample: Column) -> Column:
    """A fingerprint as text: four hexadecimal digits a sample, "none" without words."""
    return F.array_join(F.transform(sample, lambda v: F.coalesce(F.lower(F.lpad(F.hex(v), 4, "0")), F.lit("none"))), "")


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """The share of equal samples, 0 to 1."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(n))


def neighbours(ids: DataFrame, keys: list[str]) -> DataFrame:
    """ids with the keys of the next and the last row in descending order, in a circle.

    Rows are dealt by range, and each range is ordered by itself. Only the ranges'
    end rows, one row a range, meet in one task.
    """
    n = partitions(ids.sparkSession)
    dealt = table(ids.repartitionByRange(n, *[F.col(k).desc() for k in keys]).withColumn("__p", F.spark_partition_id()))
    own = Window.partitionBy("__p").orderBy(*[F.col(k).desc() for k in keys])
    here = F.struct(*ids.columns)
    ends = dealt.groupBy("__p").agg(F.max(here).alias("top"), F.min(here).alias("low"))
    row = Window.orderBy("__p")
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("__p").alias("__q"),
        F.coalesce(F.lead("top").over(row), F.first("top").over(whole)).alias("below"),
        F.coalesce(F.lag("low").over(row), F.last("low").over(whole)).alias("above"),
    )
    placed = dealt.select("*", F.lead(here).over(own).alias("__n"), F.lag(here).over(own).alias("__l"))
    joined = placed.join(F.broadcast(ends), F.col("__p") == F.col("__q"))
    return joined.select(*ids.columns, F.coalesce("__n", "below").alias("next"), F.coalesce("__l", "above").alias("last"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """(doc_id, sample array<int>) of every row: the operator's plain form."""
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("all")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.explode_outer("all").alias("w"))
    counted = rows.groupBy("row", "doc_id", "w").agg(F.count("w").alias("n")).withColumn("h", F.xxhash64("w"))
    return samples(counted, ["row", "doc_id"], {"sample": "n"}, n).drop("row")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next text.

    Edited: the last third of the characters gives way to as many (or all) from the
    start of the next document in descending order of ids, after the last the first.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).isNull().alias("anon"))
    rows = rows.withColumn("th", F.xxhash64("text", "anon"))
    ids = rows.groupBy("doc", "th").agg(F.first(F.char_length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("times"), F.first("anon").alias("anon"))
    placed = table(neighbours(ids, ["doc", "th"]))

    # one row a text, however often it repeats; sort-merge joins that keep its partitioning, so that all can spill
    texts = rows.select("doc", "th", "text").dropDuplicates(["doc", "th"])
    give = placed.select("doc", "th", F.col("last.doc").alias("to_doc"), F.col("last.th").alias("to_th"), F.floor(F.col("last.n") / 3).cast("int").alias("need"))
    heads = texts.join(give.hint("merge"), ["doc", "th"]).select(F.col("to_doc").alias("doc"), F.col("to_th").alias("th"), F.expr("substring(text, 1, need)").alias("head"))
    about = placed.select("doc", "th", "n")
    both = texts.join(about.hint("merge"), ["doc", "th"]).join(heads.hint("merge"), ["doc", "th"])
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n - floor(n / 3) as int)), head)"))
    shas = both.select("doc", "th", F.sha2("edited", 256).alias("sha"))
    split = both.select("doc", "th", words(F.col("text")).alias("a"), words(F.col("edited")).alias("b"))
    each = split.select("doc", "th", F.size("a").alias("na"), F.posexplode_outer(F.concat("a", "b")).alias("pos", "w"))
    counted = each.groupBy("doc", "th", "w").agg(
        F.count(F.when(F.col("pos") < F.col("na"), 1)).alias("n1"),
        F.count(F.when(F.col("pos") >= F.col("na"), 1)).alias("n2"),
    ).withColumn("h", F.xxhash64("w"))
    marked = samples(counted, ["doc", "th"], {"one": "n1", "two": "n2"}, n)
    # 16 bits a sample while they are written and shuffled
    short = lambda c: F.transform(c, lambda v: (v - 32768).cast("short")).alias(c)
    done = table(marked.select("doc", "th", short("one"), short("two")).join(shas, ["doc", "th"]))
    out = placed.join(done, ["doc", "th"])
    beside = done.select(F.col("doc").alias("next_doc"), F.col("th").alias("next_th"), F.col("one").alias("other"))
    out = out.join(beside, (out["next.doc"] == beside.next_doc) & (out["next.th"] == beside.next_th))
    out = out.withColumn("again", F.explode(F.expr("sequence(1L, times)")))
    return out.select(
        F.when(~F.col("anon"), F.col("doc")).alias("doc_id"), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        *[text_of(F.transform(c, lambda v: v.cast("int") + 32768)).alias(name) for c, name in (("one", "fingerprint"), ("two", "edited_fingerprint"))],
        likeness(F.col("one"), F.col("two"), n).alias("near_edited"), likeness(F.col("one"), F.col("other"), n).alias("near_next"),
    )
