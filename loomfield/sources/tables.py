"""Readers and writers of JSON lines, JSON, CSV manifests, blocks and file digests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.sources.numbered import check_lines


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict: lines that are no objects of the schema are an error, which names file and line; blank lines are skipped, absent keys are null.

    The lines are parsed once for that check, before the result is read.
    """
    check_lines(spark, path, schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def read_jsonl_if_any(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Permissive: a missing file has no rows, a bad line is a row of nulls."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE") if exists(spark, path) else spark.createDataFrame([], schema)


def read_jsonl_some(spark: SparkSession, path: str, schema: str | T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """Strict, at least one row, and no row whose required fields are null or empty."""
    rows = read_jsonl(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    if required:
        lacks = rows.agg(*(F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in required)).first()
        if bad := [c for c in required if lacks[c]]:
            raise ValueError(f"{path} has rows without {', '.join(bad)}")
    return rows


def read_jsonl_keys(spark: SparkSession, path: str, keys: tuple[str, ...], rows: int | None = None, empty: tuple[str, ...] = ()) -> DataFrame:
    """String columns for exactly the keys given; other or absent keys, another number of rows or text in the empty ones fail."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    bad = raw.where(~F.coalesce(F.sort_array(F.json_object_keys("value")) == F.array(*map(F.lit, sorted(keys))), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError(f"{path} has rows with other keys than {', '.join(keys)}")
    out = raw.select(F.from_json("value", ", ".join(f"`{k}` string" for k in keys)).alias("x")).select("x.*")
    if rows is not None and (n := out.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    for c in empty:
        if not out.where(F.coalesce(F.col(c), F.lit("-")) != "").isEmpty():
            raise ValueError(f"{path} has rows where {c} isn't empty")
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One nested document a file."""
    return spark.read.option("multiLine", True).json(path, mode="FAILFAST")


def read_blocks(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Stored blocks, all of the length given."""
    blocks = spark.read.parquet(path)
    if missing := {"input_ids", "attention_mask"} - set(blocks.columns):
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    odd = blocks.where((F.size("input_ids") != length) | (F.size("attention_mask") != length))
    if not odd.isEmpty():
        raise ValueError(f"{path} has blocks of another length than {length}")
    return blocks


def guard(spark: SparkSession, paths: list[str], overwrite: bool = False) -> None:
    """Raises if an output is there already, unless it may be overwritten."""
    there = [] if overwrite else [p for p in paths if exists(spark, p)]
    if there:
        raise FileExistsError(", ".join(there))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Keys in order, other than ASCII characters as they are. The writer's commit makes the files appear at once."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_by(df: DataFrame, column: str, path: str, overwrite: bool = False) -> None:
    """All rows, in a folder for each value of column."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(column).json(path)


def write_manifest(docs: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header, sorted over all files by split and canonical_url."""
    docs.orderBy("split", "canonical_url").write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, under a temporary name until it is whole. The rename replaces what is there in one step, so readers find the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf) if to.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    out = to.getFileSystem(conf).create(part)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(part, to, options)


def literal(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A relation of rows stated in code, checked against the schema."""
    return spark.createDataFrame(rows, schema)


def rules(spark: SparkSession) -> DataFrame:
    """The rule tables of loomfield.functions.text as a relation: rule_set, place, name, value."""
    from loomfield.functions import text

    sets = {
        "denied_terms": [(t, t) for t in text.DENIED_TERMS],
        "denied_outputs": list(text.DENIED_OUTPUTS.items()),
        "overclaims": [(f"overclaim {i}", p) for i, p in enumerate(text.OVERCLAIMS)],
    }
    return literal(spark, [(n, i, name, value) for n, entries in sets.items() for i, (name, value) in enumerate(entries)], "rule_set string, place int, name string, value string")


#: Bytes of a file that are read at once for its digest.
CHUNK = 4 << 20


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file, read in chunks, so files of any size do."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
                h = hashlib.sha256()
                with store.open_input_stream(at) as f:
                    while data := f.read(CHUNK):
                        h.update(data)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["path", "length", "sha256"])

    return found.mapInArrow(digest, "path string, length long, sha256 string")
