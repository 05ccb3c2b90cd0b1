"""Session and table helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, the warehouse, or in local mode a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.lorefold.shared", None)
        if not path:
            if spark.sparkContext.master.startswith("local"):
                path = "file://" + tempfile.mkdtemp(prefix="lorefold-")
            else:
                path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lorefold"
            spark.conf.set("spark.lorefold.shared", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores in front as make it clash with none of df's, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text (null: empty text) modulo modulus."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def stars(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (node, c): for each node of links its least neighbour's least neighbour, so that nodes of one c are connected; and the table they are read from."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    one = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")).select("node", F.least("node", "c").alias("c")), "stars")
    up = one.select(F.col("node").alias("c"), F.col("c").alias("root"))
    return one.join(up.hint("merge"), "c", "left").select("node", F.coalesce("root", "c").alias("c")), one


def relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Rows (node, c), written, after new links (u, v): nodes of one c are connected; a node without a row is its own."""
    if label is None:
        star, table = stars(links)
        out = written(star, "labels")
        discard(table)
        return out
    l1, l2 = (label.select(F.col("node").alias(n), F.col("c").alias(f"c{n}")) for n in ("u", "v"))
    e = links.join(l1.hint("merge"), "u", "left").join(l2.hint("merge"), "v", "left")
    e = written(e.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct(), "label-links")
    star, table = stars(e)
    up = star.select(F.col("node").alias("c"), F.col("c").alias("root"))
    ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    every = label.union(ends.join(label.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("c")))
    out = written(every.join(up.hint("merge"), "c", "left").select("node", F.coalesce("root", "c").alias("c")), "labels")
    discard(e, table)
    return out


def joined_up(label: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, c), written, one c for each component of links (u, v); label: what relabelled gave for a part of the links. Only what label leaves apart takes steps."""
    l1, l2 = (label.select(F.col("node").alias(n), F.col("c").alias(f"c{n}")) for n in ("u", "v"))
    e = links.join(l1.hint("merge"), "u", "left").join(l2.hint("merge"), "v", "left")
    e = written(e.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct(), "label-links")
    group = components(e)
    up = group.select(F.col("node").alias("c"), F.col("component").alias("root"))
    old = label.join(up.hint("merge"), "c", "left").select("node", F.coalesce("root", "c").alias("c"))
    new = group.join(label.hint("merge"), "node", "left_anti").select("node", F.col("component").alias("c"))
    out = written(old.union(new), "labels")
    discard(e)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, component), component being the least node of each.

    Alternating large-star and small-star steps, each a grouped minimum and a join; every step is written to
    the shared folder. Nodes without an edge do not appear; an empty edge table gives an empty result.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = state(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        small = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        )
        before, e = e, written(small.distinct(), "edges")
        discard(before)
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
