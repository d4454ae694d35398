"""Size-tiered shards under a versioned manifest, in DataFrame operations only.

A store is a folder::

    data/__gl_batch=<id>/__gl_shard=<id>/part-*.parquet   immutable shards
    manifests/entries-<uuid>/     a version's shards: id, bytes, rows, birth
    manifests/v00000001           a file that names the version's entries and holds the schema

``append`` writes arrivals as small shards, without a shuffle. ``compact`` merges
runs: shards below the target size fall into tiers of similar size (powers of
``fanout``), a tier's shards are laid end to end in order of age, and every stretch
of about the target size whose shards number ``fanout`` or more is a run. A run
becomes one shard, or as many target-sized ones as it fills. All runs merge in one
job; ``compact`` is called again until no run is due.

A version is committed by renaming a finished file to its number, after every shard
that it names has been found in the folder; the rename fails if another writer has
taken that number, so each version has one author, and readers see a version whole or
not at all. A reader fails, rather than return less, if a shard of its version is
gone. Failed or repeated tasks leave no trace: files count only once a manifest names
their shard.

``vacuum`` deletes shards that none of the newest ``keep`` versions names and that are
older than ``older_than`` seconds. The age protects what a writer has written and not
yet committed, so it must exceed the longest append or compaction; only a store's
single user may set it to 0.

Bytes are those of the files. Defined results: all rows are kept as they are, with
nulls, repeats, very long texts and any columns but those whose names start with
``__gl_``. The first frame, which may be empty, sets the columns and types; a later
one must have the same, in any order. An empty frame adds no shard, and a store of
empty frames reads as no rows. Reading a store without a version is an error.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import partitions

BATCH, SHARD = "__gl_batch", "__gl_shard"
#: Rows of the merge plan up to which it is broadcast; beyond it the join is shuffled.
BROADCAST_SHARDS = 100_000
#: Shards that one task plans; more are planned in lanes.
LANE_SHARDS = 10_000
#: Seconds that an unnamed shard is kept.
OLDER_THAN = 7 * 86_400
_ENTRY = "shard string, bytes long, rows long, born long"


class ShardStore:
    """A store of shards at ``path``, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fanout: int = 4, small_rows: int = 20_000) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fanout, self.small_rows = target_bytes, fanout, small_rows

    # -- file system, for names and the commit only
    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _context(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop(self.path).toUri(), conf)

    def versions(self) -> list[int]:
        """The committed versions in order."""
        fs, at = self._fs(), self._hadoop(f"{self.path}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max(self.versions(), default=0)

    def _head(self, version: int) -> tuple[str, StructType]:
        """The name of a version's entries and the schema of its rows."""
        head = json.loads(self.spark.read.text(f"{self.path}/manifests/v{version:08d}").first()[0])
        return head["entries"], StructType.fromJson(head["schema"])

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, bytes, rows, born) of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(f"{self.path}/manifests/{self._head(version)[0]}")

    def _files(self) -> DataFrame:
        """(shard, batch, bytes, changed) of each shard in the folder, finished or not."""
        fs, at = self._fs(), self._hadoop(f"{self.path}/data")
        if not fs.exists(at):
            return self.spark.createDataFrame([], "shard string, batch string, bytes long, changed timestamp")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data")
        part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)/", 1)
        named = files.select(part(SHARD).alias("shard"), part(BATCH).alias("batch"), "length", "modificationTime").filter("shard <> ''")
        return named.groupBy("shard", "batch").agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("changed"))

    def _commit(self, entries: DataFrame, base: int, schema: StructType) -> int:
        """Write entries and make them version base + 1, or fail if that exists or a shard is gone."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        name = f"entries-{uuid.uuid4().hex}"
        entries.select("shard", "bytes", "rows", "born").coalesce(max(1, min(8, partitions(self.spark)))).write.parquet(f"{self.path}/manifests/{name}")
        self._all_there(self.spark.read.schema(_ENTRY).parquet(f"{self.path}/manifests/{name}"))
        ready = self._hadoop(f"{self.path}/manifests/_ready-{name}")
        out = fs.create(ready, False)
        out.write(bytearray(json.dumps({"entries": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._context().rename(ready, self._hadoop(f"{self.path}/manifests/v{base + 1:08d}"), none)
        return base + 1

    def _all_there(self, entries: DataFrame) -> None:
        gone = entries.join(self._files().select("shard"), "shard", "left_anti").first()
        if gone:
            raise FileNotFoundError(f"shard {gone.shard} of the store {self.path} is gone")

    def _rows(self, schema: StructType, at: str = "") -> DataFrame:
        full = StructType([*schema.fields, StructField(BATCH, StringType()), StructField(SHARD, StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data{at}").drop(BATCH)

    def _written(self, batch: str, born: int, schema: StructType) -> DataFrame:
        """Manifest entries of a batch's shards, from file sizes and footers."""
        rows = self._rows(schema, f"/{BATCH}={batch}").groupBy(F.col(SHARD).alias("shard")).agg(F.count(F.lit(1)).alias("rows"))
        sizes = self._files().filter(F.col("batch") == batch)
        return sizes.join(rows, "shard").select("shard", "bytes", "rows", F.lit(born).cast("long").alias("born"))

    def append(self, df: DataFrame) -> int:
        """Add a frame as small shards; returns the new version.

        Each task writes its rows as it reads them: the shard is named by the
        task's place and by its own run of ``small_rows`` rows.
        """
        base, batch = self.version(), uuid.uuid4().hex[:12]
        schema = self._head(base)[1] if base else StructType([StructField(f.name, f.dataType) for f in df.schema])
        kinds = lambda s: {f.name: f.dataType.simpleString() for f in s}
        if kinds(schema) != kinds(df.schema):
            raise ValueError(f"the store has {schema.simpleString()}, not {df.schema.simpleString()}")
        place = F.monotonically_increasing_id()
        name = F.concat(F.lit(f"a-{batch}-"), F.shiftright(place, 33).cast("string"), F.lit("-"), F.floor(place.bitwiseAND((1 << 33) - 1) / self.small_rows).cast("string"))
        self._write(df.select(*[F.col(f"`{f.name}`") for f in schema]).withColumn(SHARD, name), batch)
        kept = self.manifest(base)
        if not self._any(batch):
            return self._commit(kept, base, schema)
        return self._commit(kept.union(self._written(batch, base + 1, schema)), base, schema)

    def _any(self, batch: str) -> bool:
        return any(x.isDirectory() for x in self._fs().listStatus(self._hadoop(f"{self.path}/data/{BATCH}={batch}")))

    def _write(self, df: DataFrame, batch: str) -> None:
        # rows stand in the order of their shards, or are sorted by it within a task
        df.write.option("compression", "zstd").partitionBy(SHARD).parquet(f"{self.path}/data/{BATCH}={batch}")

    def plan(self, version: int | None = None) -> DataFrame:
        """(shard, run, parts): the shards that a compaction would merge, by run.

        The windows are over shards, not rows, and over ``LANE_SHARDS`` of them at
        most. Compaction keeps the shards below the target size few: each tier keeps
        fewer than ``fanout`` a stretch.
        """
        live = self.manifest(version).filter(F.col("bytes") < self.target_bytes)
        lanes = live.count() // LANE_SHARDS + 1
        live = live.withColumn("tier", F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / float(1 << 20)) / F.log(F.lit(float(self.fanout))))))
        live = live.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)))
        upto = Window.partitionBy("tier", "lane").orderBy("born", "shard").rowsBetween(Window.unboundedPreceding, -1)
        laid = live.withColumn("stretch", F.floor(F.coalesce(F.sum("bytes").over(upto), F.lit(0)) / self.target_bytes))
        run = Window.partitionBy("tier", "lane", "stretch")
        full = laid.withColumn("members", F.count(F.lit(1)).over(run)).withColumn("total", F.sum("bytes").over(run)).filter(F.col("members") >= self.fanout)
        parts = F.greatest(F.lit(1), F.round(F.col("total") / self.target_bytes)).cast("int")
        return full.select("shard", F.concat_ws("-", *[F.col(c).cast("string") for c in ("tier", "lane", "stretch")]).alias("run"), parts.alias("parts"))

    def compact(self) -> int | None:
        """Merge all runs and commit; the new version, or None if no run is due."""
        base = self.version()
        if not base:
            return None
        plan = self.plan(base)
        count = plan.count()
        if not count:
            return None
        batch, schema = uuid.uuid4().hex[:12], self._head(base)[1]
        named = plan.withColumn("into", F.concat(F.lit(f"m-{batch}-"), "run"))
        steps = named.select(F.col("shard").alias("__gl_from"), F.col("into").alias("__gl_into"), F.col("parts").alias("__gl_parts"))
        self._all_there(plan.select("shard"))
        rows = self._rows(schema)
        rows = rows.join(F.broadcast(steps) if count <= BROADCAST_SHARDS else steps, F.col(SHARD) == F.col("__gl_from")).drop("__gl_from", SHARD)
        spread = F.pmod(F.monotonically_increasing_id(), F.col("__gl_parts"))
        rows = rows.withColumn(SHARD, F.concat("__gl_into", F.lit("-"), spread.cast("string"))).drop("__gl_into", "__gl_parts")
        self._write(rows.repartition(partitions(self.spark), SHARD), batch)
        kept = self.manifest(base)
        new = self._written(batch, base + 1, schema)
        return self._commit(kept.join(plan.select("shard"), "shard", "left_anti").select(*kept.columns).union(new), base, schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's shards; other shards' folders are pruned or joined away."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError(f"the store {self.path} has no version")
        schema, live = self._head(version)[1], self.manifest(version)
        self._all_there(live)
        if not self._fs().exists(self._hadoop(f"{self.path}/data")):
            return self.spark.createDataFrame([], schema)
        return self._rows(schema).join(live.select(F.col("shard").alias("__gl_live")), F.col(SHARD) == F.col("__gl_live"), "left_semi").drop(SHARD)

    def vacuum(self, keep: int = 2, older_than: float = OLDER_THAN) -> int:
        """Delete old shards that none of the newest ``keep`` versions names; how many went.

        The shards to delete come to the driver one after the other. A batch that has
        none left but those goes as one folder.
        """
        named = self.spark.createDataFrame([], "shard string")
        for version in self.versions()[-max(1, keep):]:
            named = named.union(self.manifest(version).select("shard"))
        before = F.timestamp_micros(F.lit(int((time.time() - older_than) * 1e6)))
        files = self._files().join(named.distinct().withColumn("live", F.lit(True)), "shard", "left")
        old = files.select("batch", "shard", (F.col("live").isNull() & (F.col("changed") <= before)).alias("goes"))
        batches = old.groupBy("batch").agg(F.count(F.when(F.col("goes"), 1)).alias("go"), F.count(F.lit(1)).alias("all")).filter("go > 0")
        whole = batches.filter("go = all").select("batch", F.lit(None).cast("string").alias("shard"), "go")
        single = old.filter("goes").join(batches.filter("go < all").select("batch"), "batch", "left_semi").select("batch", "shard", F.lit(1).cast("long").alias("go"))
        fs, gone = self._fs(), 0
        for row in whole.union(single).toLocalIterator():
            fs.delete(self._hadoop(f"{self.path}/data/{BATCH}={row.batch}" + (f"/{SHARD}={row.shard}" if row.shard else "")), True)
            gone += row.go
        return gone
