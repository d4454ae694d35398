"""Named data sets: Parquet folders with a JSON description each.

The description (``_dataset.json``; Spark's readers skip it) has the schema, geometry
column, reference system, bounds, row count and, for clustered sets, the quad keys
with their counts. All files go through Hadoop's file systems, so a catalog may lie
wherever Spark can write.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import st
from ..operators import quadkey
from ..operators.frame import GeoFrame
from ..operators.quadkey import OUTLIER, bounds as tile_bounds
from ..operators.sjoin import row_bytes
from ..runtime import spread

INFO = "_dataset.json"
TYPES = ("FILE", "TEXT", "SPATIAL_CLUSTER")
#: Bytes of rows from which a clustered copy is made by many tasks, however few files or tiles the rows have.
MUCH_BYTES = 32 << 20


class DataSetNotFound(KeyError):
    pass


class DataSetExists(ValueError):
    pass


@dataclass
class Defaults:
    """Sizes in bytes, and the number of packs that clustered files are coalesced to."""

    block_size: int = 64 << 20
    text_block_size: int = 128 << 20
    cluster_size: int = 64 << 20
    partitions: int = 7
    compression: str = "zstd"

    @staticmethod
    def of(spark: SparkSession) -> "Defaults":
        """Overridden by ``geoloom.default.<name>`` settings of the session."""
        out = Defaults()
        for name, v in asdict(out).items():
            setattr(out, name, type(v)(spark.conf.get(f"geoloom.default.{name}", str(v))))
        return out


@dataclass
class Info:
    id: str
    type: str = "FILE"  # FILE, TEXT, SPATIAL_CLUSTER
    schema: str = ""
    geom: str | None = None
    srid: str | None = None
    bounds: list[float] | None = None  # xmin, xmax, ymin, ymax
    count: int = 0
    block_size: int = 0
    compression: str = "zstd"
    updated_millis: int = 0
    clusters: dict[str, int] = field(default_factory=dict)  # quad key to rows, repeated ones included
    owned: int = 0
    keys: list[str] = field(default_factory=list)  # columns that name folders


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.defaults = Defaults.of(spark)

    # -- files
    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, id: str) -> str:
        return f"{self.root}/{id.strip('/')}"

    def _write_info(self, info: Info) -> None:
        """Replace the description as a whole: a finished file is renamed over it."""
        info.updated_millis = int(time.time() * 1000)
        at, ready = (self._path(f"{self._at(info.id)}/{name}") for name in (INFO, f"_{uuid.uuid4().hex}.json"))
        out = self._fs().create(ready, True)
        out.write(bytearray(json.dumps(asdict(info)).encode()))
        out.close()
        sc = self.spark.sparkContext
        kind = sc._jvm.org.apache.hadoop.fs.Options.Rename
        over = sc._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), sc._jsc.hadoopConfiguration()).rename(ready, at, over)

    def info(self, id: str) -> Info:
        got = self.info_or_none(id)
        if got is None:
            raise DataSetNotFound(id)
        return got

    def info_or_none(self, id: str) -> Info | None:
        at = self._path(f"{self._at(id)}/{INFO}")
        if not self._fs().exists(at):
            return None
        stream = self._fs().open(at)
        try:
            jvm = self.spark.sparkContext._jvm
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Info(**json.loads(text))

    # -- lookup
    def get(self, id: str) -> "DataSet":
        return DataSet(self, self.info(id))

    def get_or_none(self, id: str) -> "DataSet | None":
        got = self.info_or_none(id)
        return DataSet(self, got) if got else None

    def all(self) -> list["DataSet"]:
        return self.in_dir("", True)

    def in_dir(self, folder: str, recursive: bool = False) -> list["DataSet"]:
        """Data sets below a folder, sorted by id."""
        out: list[DataSet] = []

        def walk(at: str, depth: int) -> None:
            if not self._fs().exists(self._path(f"{self.root}/{at}" if at else self.root)):
                return
            for s in self._fs().listStatus(self._path(f"{self.root}/{at}" if at else self.root)):
                name = s.getPath().getName()
                if s.isDirectory() and not name.startswith(("_", ".")) and "=" not in name:
                    id = f"{at}/{name}" if at else name
                    got = self.get_or_none(id)
                    if got:
                        out.append(got)
                    elif recursive:
                        walk(id, depth + 1)

        walk(folder.strip("/"), 0)
        return sorted(out, key=lambda d: d.info.id)

    # -- changes
    def create(self, id: str, schema: T.StructType | str, geom: str | None = None, srid: str | None = None, force: bool = False, type: str = "FILE", block_size: int | None = None, compression: str | None = None) -> "DataSet":
        """Register an empty data set; ``force`` deletes one of that name and its files first.

        A TEXT set has one string column, a row for each line of its files.
        """
        if type not in TYPES:
            raise ValueError(f"unknown data set type {type!r}")
        if self.info_or_none(id):
            if not force:
                raise DataSetExists(id)
            self.delete(id)
        text = schema if isinstance(schema, str) else schema.json()
        info = Info(id.strip("/"), type, text, geom, srid, block_size=block_size or (self.defaults.text_block_size if type == "TEXT" else self.defaults.block_size), compression=compression or self.defaults.compression)
        self._write_info(info)
        return DataSet(self, info)

    def delete(self, id: str) -> bool:
        return bool(self._fs().delete(self._path(self._at(id)), True))

    def delete_dir(self, folder: str) -> list[str]:
        ids = [d.info.id for d in self.in_dir(folder, True)]
        for id in ids:
            self.delete(id)
        return ids

    def _stats(self, df: DataFrame, geom: str | None) -> tuple[int, list[float] | None]:
        cols = [F.count(F.lit(1)).alias("n")]
        if geom:
            e = st.envelope(F.col(f"`{geom}`"), df.schema[geom].dataType)
            cols += [F.min(e["xmin"]).alias("a"), F.max(e["xmax"]).alias("b"), F.min(e["ymin"]).alias("c"), F.max(e["ymax"]).alias("d")]
        r = df.agg(*cols).first()
        return r[0], [r[1], r[2], r[3], r[4]] if geom and r[1] is not None else None

    def store(self, frame: GeoFrame, id: str, force: bool = False, append: bool = False, partition_id: str | None = None, **options: Any) -> "DataSet":
        """Write a frame as a data set, or add to one of the same columns and types.

        ``partition_id`` names the part that is written; written again, as by a retry,
        it replaces what it held.
        """
        old = self.info_or_none(id)
        if old and append:
            kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
            if kinds(DataSet(self, old).schema) != kinds(frame.schema):
                raise ValueError(f"the columns or types of {id} differ: {DataSet(self, old).schema.simpleString()} and {frame.schema.simpleString()}")
            info = old
        else:
            info = self.create(id, frame.schema, frame.geom, frame.srid, force, **options).info
        at = self._at(id) + f"/part={partition_id or uuid.uuid4().hex}"
        if info.type == "TEXT":
            if [f.dataType.simpleString() for f in frame.schema] != ["string"]:
                raise ValueError("a TEXT set has one string column")
            frame.df.write.mode("overwrite").text(at)
        else:
            df = frame.df
            if frame.geom:  # plain columns that range queries are pushed down to
                box = st.envelope(F.col(f"`{frame.geom}`"), frame.schema[frame.geom].dataType)
                df = df.withColumns({f"__{n}": box[n] for n in ("xmin", "xmax", "ymin", "ymax")})
            df.write.mode("overwrite").option("compression", info.compression).option("parquet.block.size", info.block_size).parquet(at)
        done = DataSet(self, info)
        if partition_id:  # all parts anew, as one may have been replaced
            info.count, info.bounds = self._stats(done._rows(True).select(*[F.col(f"`{c}`") for c in frame.columns]), frame.geom)
        else:
            part = self.spark.read.text(at) if info.type == "TEXT" else self.spark.read.parquet(at).select(*[F.col(f"`{c}`") for c in frame.columns])
            count, box_ = self._stats(part, frame.geom)
            info.count += count
            if box_:
                b = info.bounds or box_
                info.bounds = [min(b[0], box_[0]), max(b[1], box_[1]), min(b[2], box_[2]), max(b[3], box_[3])]
        self._write_info(info)
        return done

    def store_by_key(self, frame: GeoFrame, id: str, keys: str, force: bool = False) -> "DataSet":
        """A folder for each key (``a=1/b=2``); rows of a key are dealt together, so that it has few files."""
        info = self.create(id, frame.schema, frame.geom, frame.srid, force).info
        names = info.keys = [k.strip() for k in keys.split(",")]
        frame.df.repartition(*[F.col(k) for k in names]).write.option("compression", info.compression).partitionBy(*names).parquet(self._at(id) + "/part=0")
        info.count, info.bounds = self._stats(frame.df, frame.geom)
        self._write_info(info)
        return DataSet(self, info)

    def read_files(self, path: str, format: str = "parquet", geom: str | None = None, srid: str | None = None, **options: Any) -> GeoFrame:
        """Files that are no data set of the catalog, by one of Spark's readers."""
        return GeoFrame(self.spark.read.format(format).options(**options).load(path), geom, srid)

    def store_clustered(self, frame: GeoFrame, id: str, keys: list[str], force: bool = False, bind_outlier: bool = True, packs: int | None = None, valid: tuple | None = None, block_size: int | None = None) -> "DataSet":
        """Cluster by quad keys: consecutive keys lie together in ``packs`` ranges (a crowded tile of a large set in several), and a row lies in each tile that it meets.

        Without ``packs`` there are as many as the rows' bytes, which a job sums up, need
        at the default cluster size, and ``Defaults.partitions`` at least. Rows beyond
        ``valid`` (xmin, ymin, xmax, ymax) are outliers, kept if ``bind_outlier``.
        """
        info = self.create(id, frame.schema, frame.geom, frame.srid, force, "SPATIAL_CLUSTER", block_size).info
        rows, ranges = frame.df, ["quad_key"]
        if not packs:
            size = frame.df.agg(F.sum(row_bytes(frame.df))).first()[0] or 0
            packs = max(self.defaults.partitions, math.ceil(size / self.defaults.cluster_size))
            if size > MUCH_BYTES:  # neither one file nor one crowded tile is one task's
                rows, ranges = spread(rows), ["quad_key", "__salt"]
        # each copy knows all tiles of its row; the first in order owns it
        df = quadkey.attach(rows, frame.geom, keys, valid, bind_outlier, tiles="__tiles").drop("mbr")
        df = df.withColumn("__owned", F.col("quad_key") == F.get("__tiles", F.lit(0)))
        salt = F.xxhash64("quad_key", *[F.col(f"`{f.name}`") for f in frame.schema if "map<" not in f.dataType.simpleString()])  # maps have no hash
        ranged = df.withColumn("__salt", salt).repartitionByRange(packs, *ranges).drop("__salt").sortWithinPartitions("quad_key")
        ranged.write.option("compression", info.compression).option("parquet.block.size", info.block_size).partitionBy("quad_key").parquet(self._at(id) + "/part=0")
        stored = DataSet(self, info)._rows(True)
        rows = stored.groupBy("quad_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("__owned").alias("o")).collect() if self._any(id) else []  # one a key
        info.clusters, info.owned = {r.quad_key: r.n for r in rows}, sum(r.o for r in rows)
        info.count = info.owned
        info.bounds = self._stats(stored.filter("__owned").select(*[F.col(f"`{c}`") for c in frame.columns]), frame.geom)[1] if rows else None
        self._write_info(info)
        return DataSet(self, info)

    def _any(self, id: str) -> bool:
        at = self._path(self._at(id) + "/part=0")
        return any(x.isDirectory() for x in self._fs().listStatus(at)) if self._fs().exists(at) else False


class DataSet:
    def __init__(self, catalog: Catalog, info: Info) -> None:
        self.catalog, self.info = catalog, info

    @property
    def id(self) -> str:
        return self.info.id

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.info.schema))

    def _rows(self, written: bool = False) -> DataFrame:
        spark = self.catalog.spark
        if not written and not self.info.count and not self.info.clusters:
            return spark.createDataFrame([], self.schema)
        reader = spark.read.option("basePath", self.catalog._at(self.id))
        if self.info.type == "TEXT":
            return reader.text(self.catalog._at(self.id)).select(F.col("value").alias(self.schema.names[0]))
        # folders' values are read as the types say, and not as they look: quad keys are no numbers
        if self.info.type == "SPATIAL_CLUSTER":
            own = [T.StructField("__tiles", T.ArrayType(T.StringType())), T.StructField("__owned", T.BooleanType()), T.StructField("quad_key", T.StringType())]
            reader = reader.schema(T.StructType([*self.schema.fields, *own]))
        elif self.info.keys:
            reader = reader.schema(self.schema)
        return reader.parquet(self.catalog._at(self.id))

    def read(self) -> GeoFrame:
        """All rows, each once."""
        df = self._rows()
        if self.info.type == "SPATIAL_CLUSTER" and "__owned" in df.columns:
            df = df.filter("__owned")
        return GeoFrame(df.select(*[F.col(f"`{c}`") for c in self.schema.names]), self.info.geom, self.info.srid)

    def query(self, box: tuple[float, float, float, float]) -> GeoFrame:
        """Rows that meet (xmin, ymin, xmax, ymax): bounds go to the scan, or the tiles prune folders."""
        df, names = self._rows(), [F.col(f"`{c}`") for c in self.schema.names]
        if self.info.type == "SPATIAL_CLUSTER" and "quad_key" in df.columns:
            df = self._tiles(df, [k for k in self.info.clusters if k == OUTLIER or _meet(tile_bounds(k), box)])
        elif "__xmin" in df.columns:
            x0, y0, x1, y1 = box
            df = df.filter((F.col("__xmin") <= x1) & (F.col("__xmax") >= x0) & (F.col("__ymin") <= y1) & (F.col("__ymax") >= y0))
        return GeoFrame(df.select(*names), self.info.geom, self.info.srid).filter_spatial(box)

    @staticmethod
    def _tiles(df: DataFrame, hit: list[str]) -> DataFrame:
        """The rows of some tiles; one that lies in several of them is taken from the first."""
        key = F.col("quad_key")
        return df.filter(key.isin(hit) & (key == F.array_min(F.array_intersect(F.col("__tiles"), F.array(*map(F.lit, sorted(hit))).cast("array<string>")))))

    def near(self, frame: GeoFrame, dist: float = 0.0) -> GeoFrame:
        """The rows in tiles that any geometry of a frame meets: what a join with it can need.

        The frame's tiles are found by a job that brings at most one row a key to the
        driver. Only the folders of these tiles are read.
        """
        if not self.info.clusters:
            return self.read()
        box = st.envelope(*frame._geometry())
        grown = st.box_of(box["xmin"] - dist, box["xmax"] + dist, box["ymin"] - dist, box["ymax"] + dist)
        met = quadkey.attach(frame.df.select(grown.alias("__box")), "__box", self.quad_keys(), bind_outlier=False).select("quad_key").distinct()
        hit = {OUTLIER, *(r.quad_key for r in met.collect())} & set(self.info.clusters)
        return GeoFrame(self._tiles(self._rows(), sorted(hit)).select(*[F.col(f"`{c}`") for c in self.schema.names]), self.info.geom, self.info.srid)

    @property
    def bounds(self) -> list[float] | None:
        return self.info.bounds

    @property
    def count(self) -> int:
        return self.info.count

    def length(self) -> int:
        """Bytes of the files; 0 without any."""
        return int(self.catalog._fs().getContentSummary(self.catalog._path(self.catalog._at(self.id))).getLength())

    @property
    def has_spatial_index(self) -> bool:
        return bool(self.info.clusters)

    def spatial_index_info(self) -> dict[str, Any]:
        return {"bounds": self.info.bounds, "clusters": len(self.info.clusters), "owned": self.info.owned, "total": sum(self.info.clusters.values())}

    def quad_keys(self) -> list[str]:
        return sorted(k for k in self.info.clusters if k != OUTLIER)

    def cluster(self, into: str, keys: list[str] | None = None, keys_of: str | None = None, sample_bytes: int = 64 << 20, cluster_bytes: int | None = None, force: bool = False, packs: int | None = None, valid: tuple | None = None, block_size: int | None = None, bind_outlier: bool = True) -> "DataSet":
        """A clustered copy: by given keys, by another set's keys, or by keys estimated from a sample within ``valid``."""
        frame = self.read()
        if keys is None and keys_of:
            keys = self.catalog.get(keys_of).quad_keys()
        if keys is None:
            ratio = min(1.0, sample_bytes / max(1, self.length()))
            keys = frame.estimate_quad_keys(ratio, valid, cluster_bytes or self.catalog.defaults.cluster_size)
        return self.catalog.store_clustered(frame, into, keys, force, bind_outlier, packs, valid, block_size)

    def delete(self) -> bool:
        return self.catalog.delete(self.id)


def _meet(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
