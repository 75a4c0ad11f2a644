"""Rows of text files with their numbers, for reading by position and for naming bad lines.

A file is read in splits by many tasks. Rows are stored with their split and their order in it; counts by split are summed up
over the splits before, and a row's number is that sum and its place in its split. Only one row for each split (128 MB by default) goes through a
window, so no task sees a whole file or table. Files come in the order of their paths, as Spark's writers number theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions.urls import strip
from loomfield.plans.shared import broadcast_if_small, materialize

#: Splits of so many at most are sent to all tasks, some 200 bytes each.
MOST_SPLITS = 200_000


def numbered_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """file, line, position, value of the lines of the files of path: line from 1 in a file, position from 0 in all of them.

    Lines of white space only aren't there and don't count, unless blank is set, as for the line numbers that an editor shows.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    rows = materialize((raw if blank else raw.where(strip(F.col("value")) != "")).withColumn("at", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = splits.select("file", "split", "first", before(Window.partitionBy("file").orderBy("split")).alias("in_file"), before(Window.orderBy("file", "split")).alias("in_all"))
    own = rows.join(broadcast_if_small(materialize(sums, "splits"), MOST_SPLITS), ["file", "split"])
    nth = F.col("at") - F.col("first")
    return own.select("file", (F.col("in_file") + nth + 1).alias("line"), (F.col("in_all") + nth).alias("position"), "value")


def _struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def parsed(value: Column, schema: str | T.StructType) -> tuple[Column, Column]:
    """(the object of a line as a struct, whether the line is no object of the schema). Absent keys are null, others are ignored."""
    kind = _struct(schema)
    bad = "_bad"
    while bad in kind.names:
        bad += "_"
    whole = T.StructType([*kind.fields, T.StructField(bad, T.StringType())])
    x = F.from_json(value, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "allowSingleQuotes": "false"})
    plain = strip(value)
    wrong = ~(F.startswith(plain, F.lit("{")) & F.endswith(plain, F.lit("}"))) | x[bad].isNotNull()
    return F.struct(*(x[n].alias(n) for n in kind.names)), F.coalesce(wrong, F.lit(True))


def bad_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """file, line, value of lines that are no object of the schema. Lines of white space only are none of them."""
    rows = numbered_lines(spark, path, blank=True)
    return rows.where((strip(F.col("value")) != "") & parsed(F.col("value"), schema)[1]).select("file", "line", "value")


def check_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> None:
    """Raises with file and line of the first lines that are no object of the schema. Lines are only numbered if there is one."""
    raw = spark.read.text(path)
    if raw.where((strip(F.col("value")) != "") & parsed(F.col("value"), schema)[1]).isEmpty():
        return
    first = bad_lines(spark, path, schema).orderBy("file", "line").limit(5).collect()
    raise ValueError("no object of the schema at " + ", ".join(f"{r.file}:{r.line}" for r in first))


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """position, file, and the schema's columns, of JSON lines. A line that is no object of the schema fails the job with its file and position."""
    rows = numbered_lines(spark, path)
    value, bad = parsed(F.col("value"), schema)
    where = F.concat(F.lit("no object of the schema at "), F.col("file"), F.lit(", row "), F.col("position").cast("string"))
    checked = F.when(bad, F.raise_error(where).cast(_struct(schema))).otherwise(value)
    return rows.select("position", "file", checked.alias("x")).select("position", "file", "x.*")


def last_rows(rows: DataFrame, key: str, ordinal: str = "position") -> DataFrame:
    """Of the rows of a key the last by ordinal; one aggregate, so a key with many rows is reduced before it moves. Rows without a key are none."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(ordinal, *rest), ordinal).alias("__last"))
    return last.select(key, *(F.col("__last")[c].alias(c) for c in (ordinal, *rest)))


def zipped(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right"), by: str = "position") -> DataFrame:
    """by, and both tables' other columns as two structs, joined by position; the struct of a table without that position is null."""
    sides = [d.select(by, F.struct(*(c for c in d.columns if c != by)).alias(n)) for d, n in zip((left, right), names)]
    return sides[0].join(sides[1], by, "full_outer")
