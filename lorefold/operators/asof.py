"""As-of lookups within groups of any size: the latest earlier row of a group, found by pieces of a range partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.sources.tables import written


def _pieces(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, group, *order).withColumn("_piece", F.spark_partition_id()), "asof")


def running_max(rows: DataFrame, group: str, order: list[str], value: Column, out: str) -> DataFrame:
    """rows with out: the greatest value of the group's rows up to and including this one. Groups are cut as in previous."""
    cut = _pieces(rows.withColumn("_value", value), group, order)
    inside = Window.partitionBy(group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.groupBy(group, "_piece").agg(F.max("_value").alias("_end"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a partition
    carried = ends.select(F.col(group).alias("_group"), F.col("_piece").alias("_p"), F.max("_end").over(before).alias("_carried")).where("_carried IS NOT NULL")
    local = cut.withColumn("_here", F.max("_value").over(inside))
    j = local.join(carried.hint("merge"), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_piece") == F.col("_p")), "left")
    return j.select(*rows.columns, F.greatest("_here", "_carried").alias(out))


def previous(rows: DataFrame, group: str, order: list[str], value: str, out: str, other: str | None = None) -> DataFrame:
    """rows with out: value of the group's latest earlier row in the order given; with other, of the latest one that has another value of other.

    Rows of a null group have none and aren't dealt out. A group that is larger than a partition is cut where the range partitioning cuts it: a window runs
    within each piece, and what earlier pieces leave behind (a row a piece and group) is carried into it. order must tell rows apart.
    """
    cut = _pieces(rows.where(F.col(group).isNotNull()), group, order)
    cut = cut.withColumn("_by", F.struct(other) if other else F.struct(*order))  # without other, every row is another one
    own = Window.partitionBy(group, "_piece").orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))
    moved = F.lag("_by").over(own) != F.col("_by")  # null on a piece's first row
    step = cut.withColumns({"_start": moved, "_last": F.lag(boxed).over(own)})
    # at the start of a run of equal rows the row before it is another one; later rows of the run look back to there
    to_here = own.rowsBetween(Window.unboundedPreceding, 0)
    local = step.withColumn("_found", F.last(F.when(F.col("_start"), F.col("_last")), ignorenulls=True).over(to_here))
    last = F.max_by(F.struct("_by", boxed.alias("v"), F.col("_found").alias("before")), F.struct(*order))
    ends = local.groupBy(group, "_piece").agg(last.alias("end"))
    held = F.collect_list("end").over(Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))  # at most a row a partition
    carried = ends.select(F.col(group).alias("_group"), F.col("_piece").alias("_p"), held.alias("_held")).where(F.size("_held") > 0)
    j = local.join(carried.hint("merge"), (F.col(group) == F.col("_group")) & (F.col("_piece") == F.col("_p")), "left")
    use = F.filter("_held", lambda e: (e["_by"] != F.col("_by")) | e["before"].isNotNull())
    late = F.try_element_at(use, F.lit(-1))
    from_before = F.when(late["_by"] != F.col("_by"), late["v"]).otherwise(late["before"])
    found = j.withColumn(out, F.coalesce(F.col("_found"), from_before)["v"]).select(*rows.columns, out)
    rest = rows.where(F.col(group).isNull()).withColumn(out, F.lit(None).cast(rows.schema[value].dataType))
    return found.unionByName(rest)
