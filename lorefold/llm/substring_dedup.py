"""Substring dedup: repeated lines or paragraphs, found by grouped digests of normalised units.

A text is cut into units: at newlines and, as a line may hold a whole paragraph or a passage that was appended to
it, after sentence ends (unit="sentence", the default); at newlines alone (unit="line"); or at blank lines
(unit="paragraph"). A unit keeps the separator behind it, so that units joined give the text back. Units are normalised
(trimmed, white space to one space, lower-cased) and digested with 128 bits. Of each digest the occurrence of least
(id, place) stays; the others are repeats, and each run of neighbouring repeats of at least min_chars normalised
characters goes. Removed runs are reported with their offsets (code points) in the original text; the cleaned
text is what is left.

Digests are counted first, by partial aggregation, so that a unit which a third of all rows hold is one row a task;
only digests of repeated units meet their occurrences: those of very many units are sent to all tasks, which are few by count,
the others in a join by digest.

Edge cases: null texts have no units and stay null; an empty text stays empty; rows that repeat an id are texts of their own,
ordered by a hash of the text, unless their texts are equal too (then they are one, and lose the same units); null ids
come last; a very long text is cut like any other; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.llm.shared import discard, free_names, written

MIN_CHARS = 40
HOT = 10_000
CUTS = {"sentence": r"(?<=\n)|(?<=[.!?] )", "line": r"(?<=\n)", "paragraph": r"(?<=\n\n)(?!\n)"}


def pieces(text: Column, unit: str = "sentence") -> Column:
    return F.split(text, CUTS[unit])


def n_pieces(text: Column, unit: str = "sentence") -> Column:
    """Number of pieces of a text, null: 1; most are counted without being made."""
    t = F.coalesce(text, F.lit(""))
    if unit == "paragraph":
        return F.size(pieces(t, unit))
    ends = ["\n"] + ([". ", "! ", "? "] if unit == "sentence" else [])
    n = sum(((F.length(t) - F.length(F.replace(t, F.lit(e), F.lit("")))) / len(e)).cast("int") for e in ends)
    return n + 1


def normal(unit: Column) -> Column:
    """Trimmed, white space to one space, lower-cased; a pattern only for units that need it, as few do."""
    body = F.when(F.endswith(unit, F.lit("\n")), F.substring(unit, F.lit(1), F.length(unit) - 1)).otherwise(unit)
    odd = F.lit(False)
    for blank in ("\n", "\t", "\x0b", "\f", "\r", "  "):
        odd = odd | F.contains(body, F.lit(blank))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(unit, r"[ \t\n\x0b\f\r]+", " ")).otherwise(body)))


def units(docs: DataFrame, doc_id: str, text: str, unit: str) -> DataFrame:
    """Rows (id, h, no, size, digest): every unit that isn't blank, by its place in the text; h: hash of the whole text."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.posexplode(pieces(F.col(text), unit)).alias("no", "u"))
    # a generated row of one keeps Spark from normalising again for each use
    rows = rows.select("id", "h", "no", F.explode(F.array(normal(F.col("u")))).alias("u")).where("u <> ''")
    return rows.select("id", "h", "no", F.length("u").alias("size"), F.unhex(F.md5(F.col("u").cast("binary"))).alias("digest"))


def repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Rows (id, h, gone): the places of each text's units that go, ascending."""
    u = written(units(docs, doc_id, text, unit), "units")
    first = u.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    first = written(first.where("n > 1"), "unit-repeats")
    # digests with over one HOT-th of all repeats, so HOT of them at most, are sent to all tasks; the others meet theirs in a merge
    often = max(2, (first.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = first.where(F.col("n") > often).select("digest", "least")
    marked = u.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    cold = first.where(F.col("n") <= often).select(F.col("digest").alias("d"), F.col("least").alias("l"))
    rare = marked.where("hot IS NULL").join(cold.hint("merge"), F.col("digest") == F.col("d"))
    columns = ("digest", "id", "h", "no", "size")
    hits = written(marked.where("hot").select(*columns, "least").union(rare.select(*columns, "l")), "unit-hits")
    # the least id keeps its first place only; every other id's occurrence is a repeat, null ids come last
    same = hits.where("id <=> least")
    kept = same.groupBy("digest").agg(F.min(F.struct("h", "no")).alias("at"), F.count("*").alias("k")).where("k > 1").drop("k")
    own = same.join(kept.hint("merge"), "digest").where(F.struct("h", "no") > F.col("at"))
    gone = hits.where("NOT id <=> least").select("id", "h", "no", "size").union(own.select("id", "h", "no", "size"))
    gone = gone.groupBy("id", "h", "no").agg(F.max("size").alias("size"))
    gone = gone.withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy("id", "h").orderBy("no")))
    gone = gone.withColumn("whole", F.sum("size").over(Window.partitionBy("id", "h", "run"))).where(f"whole >= {min_chars}")
    out = written(gone.groupBy("id", "h").agg(F.array_sort(F.collect_list("no")).alias("gone")), "unit-places")
    discard(u, first, hits)
    return out


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence", min_chars: int = MIN_CHARS
) -> DataFrame:
    """docs with n_units, removed array<struct<start, end>> (offsets in the original, by unit) and clean_text.

    A column of docs that has one of these names keeps it, and the new one gets an underscore in front.
    """
    i, h, g, c, m = free_names(docs, "id", "hash", "gone", "cut", "made")
    gone = repeated(docs, doc_id, text, unit, min_chars).select(F.col("id").alias(i), F.col("h").alias(h), F.col("gone").alias(g))
    d = docs.join(gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)), "left")
    # only texts that lose something are split again, once: a generated row of one keeps Spark from doing it for each use
    d = d.select(*docs.columns, g, F.inline(F.array(F.struct(F.when(F.col(g).isNotNull(), pieces(F.col(text), unit)).alias(c)))))
    kept = F.expr(f"array_except(sequence(0, size(`{c}`) - 1), `{g}`)")
    clean = F.when(F.col(g).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda k: F.get(F.col(c), k)), ""))
    none = "cast(array() as array<struct<start:int,end:int>>)"
    # both lists ascend: g is the number of repeats met so far
    spans = F.expr(
        f"aggregate(`{c}`, named_struct('k', 0, 'at', 0, 'g', 0, 'out', {none}), (s, x) -> named_struct('k', s.k + 1,"
        f" 'at', s.at + length(x), 'g', s.g + if(get(`{g}`, s.g) <=> s.k, 1, 0), 'out', if(get(`{g}`, s.g) <=> s.k,"
        " concat(s.out, array(named_struct('start', s.at, 'end', s.at + length(x)))), s.out)), s -> s.out)"
    )
    removed = F.when(F.col(g).isNull(), F.expr(none)).otherwise(spans)
    names = [n if n not in docs.columns else free_names(docs, n)[0] for n in ("n_units", "removed", "clean_text")]
    made = [x.alias(n) for x, n in zip((n_pieces(F.col(text), unit), removed, clean), names, strict=True)]
    return d.select(*docs.columns, F.inline(F.array(F.struct(*made))))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = without_repeats(docs)
    return d.select(
        "doc_id",
        "n_units",
        F.size("removed").alias("n_removed"),
        F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])).alias("removed"),
        F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
        F.length(F.coalesce("clean_text", F.lit(""))).cast("long").alias("clean_chars"),
    ).withColumn("removed", F.concat_ws(",", "removed"))


OP2_SQL = """
WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?] |\\n)', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS u, generate_subscripts(p, 1) AS no FROM p),
n AS (SELECT doc_id, no, u, trim(regexp_replace(u, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t,
    coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
r AS (SELECT *, t <> '' AND row_number() OVER (PARTITION BY lower(t) ORDER BY doc_id, no) > 1 AS again FROM n),
k AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, again ORDER BY no) AS run FROM r),
m AS (SELECT *, again AND sum(length(t)) OVER (PARTITION BY doc_id, again, run) >= 40 AS gone FROM k),
g AS (SELECT doc_id, CAST(count(*) AS INT) AS n_units, CAST(sum(CAST(gone AS INT)) AS INT) AS n_removed,
    coalesce(string_agg(CASE WHEN gone THEN start::BIGINT || '-' || (start + length(u))::BIGINT END, ',' ORDER BY no), '') AS removed,
    coalesce(string_agg(CASE WHEN NOT gone THEN u END, '' ORDER BY no), '') AS clean FROM m GROUP BY doc_id)
SELECT doc_id, n_units, n_removed, removed, sha256(clean) AS clean_sha256, CAST(length(clean) AS BIGINT) AS clean_chars FROM g
"""
