"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of a budget of words by its weight, at most most_copies times its own words; what
exceeds that is shared among the other sources by weight until none is above (water-filling, solved from one
ordering of the sources by limit over weight). A source's documents are then expected copies = target / source
words each, times an optional positive document weight: the whole part of that is certain, and the fractional part
is an inclusion probability p. Pareto order sampling ranks the documents by (u / (1 - u)) / (p / (1 - p)), u being
a hash of the id, and takes them from the front until the words that are still missing are reached, so that the
sample has a fixed size in words and document weights give unequal probabilities.

The cut in the ranking is found without gathering a source: words are summed in fine classes of the rank, the
sums of the classes before are accumulated, and only the class that holds the cut is ordered by document.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, placed
last; repeated rows (even of one id) are documents of their own with tied ranks, ordered by text; reruns agree;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.llm.shared import free_names, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
CLASSES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source_size and target of each source of (source, size): one row a source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    s = sums.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    left = F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / heavy)
    full = F.col("limit") <= F.col("level") * F.col("weight")
    s = s.withColumn("full", full)
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("at")))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(level["at"] * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    doc_weight: Column | None = None,
    seed: str = "mix",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The keep columns of every row with size, source_size, target, copies and taken (words, repeats counted).

    doc_weight multiplies a document's expected copies before they are cut to MOST_COPIES; a source's taken words
    still end at its target as long as its documents allow it.
    """
    size = n_words(F.col(text))
    odd = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(odd, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    d = docs.select(
        *[F.col(c) for c in keep],
        F.col(doc_id).alias("_id"),
        F.col(source).alias("_source"),
        size.alias("size"),
        u.alias("_u"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_tie"),
        (doc_weight if doc_weight is not None else F.lit(1.0)).alias("_w"),
    )
    d = written(d, "mix-sizes")  # the texts are read once
    t = targets(d.select(F.col("_source").alias("source"), "size"))
    t = t.withColumnRenamed("source", "_s")
    # one row a source: a table of sources is small against documents, and merged rather than sent whole if not
    d = d.join(t.hint("merge") if _many(t) else F.broadcast(t), F.col("_source").eqNullSafe(F.col("_s")), "left")
    expected = F.least(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) * F.col("_w"), F.lit(float(MOST_COPIES)))
    d = d.drop("_s").withColumn("_e", expected).withColumn("_sure", F.floor("_e"))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("_e") - F.col("_sure")))
    odds = F.col("_u") / (1 - F.col("_u")) / (p / (1 - p))
    d = d.withColumn("_q", F.when(F.col("_sure") >= MOST_COPIES, F.lit(float("inf"))).otherwise(odds))
    d = d.withColumn("_class", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * CLASSES), F.lit(CLASSES - 1)).cast("int"))
    d = d.withColumn("_class", F.when(F.col("_q") == float("inf"), F.lit(CLASSES)).otherwise(F.col("_class")))
    sums = d.groupBy("_source", "_class").agg(
        F.sum("size").alias("_words"), F.sum(F.col("size") * F.col("_sure")).alias("_certain"), F.max("target").alias("target")
    )
    whole = Window.partitionBy("_source")
    missing = F.col("target") - F.sum("_certain").over(whole)
    upto = F.sum("_words").over(whole.orderBy("_class"))
    sums = sums.select("_source", F.col("_class"), missing.alias("_missing"), upto.alias("_upto"), "_words")
    # rows of the last class have all the copies that they may: it is never cut, nor sorted
    cut = sums.where(F.col("_class") < CLASSES).where("_upto - _words <= _missing AND _missing < _upto").groupBy("_source").agg(
        F.min(F.struct("_class", (F.col("_upto") - F.col("_words")).alias("_before"), "_missing")).alias("_cut")
    )
    cut = cut.select(F.col("_source").alias("_s"), "_cut.*").withColumnRenamed("_class", "_at")
    d = d.join(cut.hint("merge") if _many(t) else F.broadcast(cut), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    inner = d.where("_class = _at")
    run = Window.partitionBy("_source").orderBy("_q", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("size").over(run) - F.col("size") / 2
    inner = inner.withColumn("_extra", (upto <= F.col("_missing")).cast("int"))
    outer = d.where("_at IS NULL OR _class <> _at").withColumn(
        "_extra", ((F.col("_at").isNull() | (F.col("_class") < F.col("_at"))) & (F.col("_class") < CLASSES)).cast("int")
    )
    d = outer.unionByName(inner)
    copies = F.when(F.col("size") > 0, F.col("_sure") + F.col("_extra")).otherwise(F.lit(0)).cast("int")
    return d.select(
        *keep, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def _many(table: DataFrame, limit: int = 10_000) -> bool:
    """Whether a table of one row a source is too long to be sent to every executor."""
    return len(table.select(F.lit(1)).limit(limit + 1).collect()) > limit


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns, size, target, copies and taken.

    A column of docs that has one of these names keeps it, and the new one gets an underscore in front.
    """
    columns = docs.columns
    own = {c: f"k{k}" for k, c in enumerate(columns)}
    took = mix_sources(docs.toDF(*own.values()), own["doc_id"], own["text"], own["source"], keep=tuple(own.values())).where("copies > 0")
    new = [n if n.lower() not in {c.lower() for c in columns} else free_names(docs, n)[0] for n in ("size", "target", "copies", "taken")]
    return took.select(*[F.col(k).alias(c) for c, k in own.items()], *[F.col(o).alias(n) for o, n in zip(("size", "target", "copies", "taken"), new, strict=True)])


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    md5(coalesce(text, '')) AS tie
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0::DOUBLE, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE
    (SELECT arg_min(level, cap / weight) FROM l WHERE cap > level * weight) * weight END AS target FROM l),
e AS (SELECT d.*, source_size, target, least(target / greatest(source_size, 1), 2.0::DOUBLE) AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(e) AS sure, greatest(1e-12::DOUBLE, least(1::DOUBLE - 1e-12::DOUBLE, e - floor(e))) AS p FROM e),
r AS (SELECT *, CASE WHEN sure >= 2 THEN 'infinity'::DOUBLE ELSE u / (1 - u) / (p / (1 - p)) END AS q FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, tie ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS upto,
    target - sum(size * sure) OVER (PARTITION BY source) AS missing FROM r)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE sure + CASE WHEN sure < 2 AND upto <= missing THEN 1 ELSE 0 END END AS INT) AS copies,
  CAST(CASE WHEN size = 0 THEN 0 ELSE sure + CASE WHEN sure < 2 AND upto <= missing THEN 1 ELSE 0 END END * size AS BIGINT) AS taken
FROM c
"""
