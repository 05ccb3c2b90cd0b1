"""Tables on the shared folder: intermediate ones, and sets of tables that change together.

A set of tables lives under one root. Rows are stored by bucket of their slug, each bucket's files in a folder of the run that wrote
them, and a manifest names the folder of each bucket of each table. A run writes its buckets aside and then puts the next
manifest in place by one rename that fails if there is one: readers see the old state or the new one, of all tables together.
A run that dies leaves folders that no manifest names; a run whose id is already in the history changes nothing. Buckets that a run
does not touch keep their folders, and reading for some slugs opens their buckets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class ConflictError(RuntimeError):
    """Another run has put the next manifest in place."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return (path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lorefold").rstrip("/")


def written(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """df written as Parquet to a new folder of the shared one and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for table in tables:
        fs, path = _fs(table.sparkSession, table.written_path)
        fs.delete(path, True)


def bucket_of(slug: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(slug), F.lit(buckets)).cast("int")


class TableSet:
    """Tables that change together. schemas: each table's columns as DDL, a slug column (keys) among them."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, str] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schemas, self.keys = schemas, {n: (keys or {}).get(n, "slug") for n in schemas}

    def _versions(self) -> list[int]:
        fs, path = _fs(self.spark, f"{self.root}/manifests")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(path) if f.getPath().getName()[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last one by default; an empty set's is version 0."""
        version = (self._versions() or [0])[-1] if version is None else version
        if not version:
            return {"version": 0, "runs": [], "tables": {n: {} for n in self.schemas}}
        fs, path = _fs(self.spark, f"{self.root}/manifests/{version:09d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table as one manifest has it; with buckets, these only."""
        folders = self.manifest(version)["tables"].get(name, {})
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.root}/{p}" for b, ps in sorted(folders.items()) if wanted is None or b in wanted for p in ps]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def touched(self, slugs: DataFrame, slug: str = "slug") -> list[int]:
        """The buckets of some slugs: as many numbers at most as there are buckets."""
        return sorted(r[0] for r in slugs.select(bucket_of(F.col(slug), self.buckets)).distinct().collect())

    def commit(self, run_id: str, tables: dict[str, DataFrame], buckets: Iterable[int], add: bool = False) -> bool:
        """Puts the rows of tables in the place of these buckets, in all of them at once; False if the run has been committed before.

        With add, the rows are added to what the buckets hold, whose files stay.
        Rows outside of buckets are an error of the caller's and are found. A table that a run does not name stays as it is.
        """
        if any(c in run_id for c in "/ ") or not run_id:
            raise ValueError("a run id is part of a path")
        now, buckets = self.manifest(), sorted(set(buckets))
        if run_id in now["runs"]:
            return False
        attempt = uuid.uuid4().hex[:8]
        entries = {n: dict(t) for n, t in now["tables"].items()}
        for name, rows in tables.items():
            folder = f"data/{name}/{run_id}-{attempt}"
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            placed = rows.select(*columns).withColumn("bucket", bucket_of(F.col(self.keys[name]), self.buckets))
            placed.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
            fs, path = _fs(self.spark, f"{self.root}/{folder}")
            found = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(path) if f.isDirectory()}
            if stray := found - {str(b) for b in buckets}:
                raise ValueError(f"rows of {name} in buckets that this run does not replace: {sorted(stray)}")
            for b in map(str, buckets):
                held = entries.setdefault(name, {}).pop(b, [])
                if held := (held if add else []) + [f"{folder}/bucket={b}"] * (b in found):
                    entries[name][b] = held
        self._put({"version": now["version"] + 1, "runs": [*now["runs"], run_id], "tables": entries})
        return True

    def _put(self, manifest: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = f"{self.root}/manifests/{manifest['version']:09d}.json"
        fs, aside = _fs(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(place)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 0)  # no OVERWRITE: the second of two runs fails
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(aside, target, never)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or fs.exists(target):
                raise ConflictError(f"version {manifest['version']} is there already") from e
            raise

    def unnamed(self) -> list[str]:
        """Folders of runs that no manifest in the history names: what dead runs have left."""
        named = {p.rsplit("/", 1)[0] for v in self._versions() for t in self.manifest(v)["tables"].values() for ps in t.values() for p in ps}
        out = []
        for name in self.schemas:
            fs, path = _fs(self.spark, f"{self.root}/data/{name}")
            if fs.exists(path):
                out += [f"data/{name}/{f.getPath().getName()}" for f in fs.listStatus(path) if f"data/{name}/{f.getPath().getName()}" not in named]
        return sorted(out)
