"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Within each source rows are ranged by the key's high bits and sorted, and a
distributed prefix sum of sizes says where each row lies in its source's sequence of words. A source is taken
whole as many times as its budget allows, and then up to the exact word where the budget ends.

Cases: a null text has size 0; rows of size 0 are taken 0 words. A null source is a source of its own and comes
last. A null document id counts as a digest of the text for the key. Rows with equal keys are ordered by id and
size, and in take() by a hash of the text after those; repeated rows are rows of their own. An empty table gives no rows. Columns besides doc_id, source and text
aren't read by mix(); take() keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.naming import unused
from loomfield.plans.prefix import bits_for, high_bits, prefix_in_groups
from loomfield.plans.shared import broadcast_if_small, materialize

#: Fixed values of the mix: weights by order of source, share of all sizes, most repeats.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 100_000


def mix_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """60 uniform bits of the document id, or of a digest of the text where there is none, so that rows without ids are spread too."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), own)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, n, target) of sizes(src, size), src in the order of the weights.

    The share of all words is dealt by weight and no source gets above REPEATS times its size. The excess reshared
    again and again ends at one level: sources in ascending order of cap by weight are full as long as their cap
    is below what the rest would get, and the others get the level times their weight.
    """
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    nth = (F.row_number().over(Window.orderBy("src")) - 1) % len(WEIGHTS)
    by = by.withColumn("w", F.get(F.array(*map(F.lit, WEIGHTS)), nth).cast("double")).withColumn("cap", F.col("source_size") * REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    by = by.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    by = by.withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("ws", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.col("total") * F.lit(SHARE) - F.col("caps").cast("double")) / F.col("ws"))
    by = by.withColumn("open", F.when(F.col("cap").cast("double") > F.col("w") * F.col("level"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("at", level)
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("at")))
    return by.select("src", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, source, text)."""
    return _shares(docs)


def _shares(docs: DataFrame, more: dict[str, Column] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """mix() with more columns, named by more, some of which order rows that are alike otherwise."""
    more = more or {}
    src = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select("doc_id", src.alias("src"), size.alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("key"), *(c.alias(k) for k, c in more.items())), "mix-sizes")
    goal = materialize(targets(sized), "mix-targets")
    bits = bits_for(goal.agg(F.max("n")).first()[0] or 0)
    placed = prefix_in_groups(sized.withColumn("bucket", high_bits(F.col("key"), bits)), "src", "bucket", ["key", "doc_id", "size", *ties], "size", "before")
    mixed = placed.join(broadcast_if_small(goal, MOST_SOURCES), "src")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    mixed = mixed.withColumn("whole", whole)
    budget = F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    taken = F.col("whole") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("before")))
    return mixed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *more)


def take(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken whole, and once more cut after its last word taken.

    Rows go through the mix as a whole, so each takes its own share, also where rows share an id or have none.
    """
    shares = _shares(docs, {"row": F.struct(*(docs[c] for c in docs.columns)), "tie": F.xxhash64("text")}, ("tie",))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    times = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    (most,) = unused(docs, "words")
    rows = shares.select("row", F.explode(times).alias(most)).select("row.*", most)
    first = F.regexp_extract(F.col("text"), r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.greatest(F.col(most), F.lit(0)))
    cut = F.when(F.col(most) < 0, F.col("text")).otherwise(F.concat(first, F.array_join(words, "")))
    out = {"text": cut} | ({"n_chars": F.when(F.col(most) < 0, F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return rows.withColumns(out).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '|' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY src) - 1) % 3 AS BIGINT) + 1] AS DOUBLE) AS w, 2 * source_size AS cap FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps,
        sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
l AS (SELECT *, (CAST(total AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(caps AS DOUBLE)) / ws AS level FROM c),
o AS (SELECT *, first_value(CASE WHEN CAST(cap AS DOUBLE) > w * level THEN level END IGNORE NULLS)
        OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lvl FROM l),
t AS (SELECT src, source_size, CASE WHEN lvl IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), w * lvl) END AS target FROM o),
p AS (SELECT d.*, source_size, target,
        CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
      FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM p
"""
