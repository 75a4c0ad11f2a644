"""Token streams in fixed blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.plans.prefix import bits_for, high_bits, prefix_in_groups
from loomfield.plans.shared import materialize


def words(c: Column) -> Column:
    """The default tokens of a text: runs without white space."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def token_ids(c: Column, encode: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """Ids of texts by any tokenizer; null is the empty text. encode is called once a task and returns what turns a list of texts into lists of ids."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = encode()
        for texts in batches:
            yield pa.array(run([t or "" for t in texts.to_pylist()]), pa.list_(pa.int32()))

    return of(c)


def vocabulary(path: str) -> Callable:
    """encode for token_ids() from a vocabulary file of the tokenizers library, without special tokens."""

    def encode():
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    return encode


def starts(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs(split, canonical_url, n) with start: where each document's n tokens and end token begin in its split's stream.

    Documents are ordered by a hash of split and URL; only keys and counts go through the prefix sum, which no task does for a whole split.
    """
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), "split", F.lit("|"), "canonical_url"), 256), 1, 15), 16, 10).cast("long")
    keyed = materialize(docs.withColumns({"__key": key, "__n": F.col("n") + 1}), "stream")
    bits = bits_for(keyed.groupBy("split").count().agg(F.max("count")).first()[0] or 0)
    placed = prefix_in_groups(keyed.withColumn("__bucket", high_bits(F.col("__key"), bits)), "split", "__bucket", ["__key", "canonical_url"], "__n", "start")
    return placed.drop("__key", "__n", "__bucket")


def pack(docs: DataFrame, length: int, end: int, pad: int, seed: int = 42) -> DataFrame:
    """split, block, input_ids, attention_mask from docs(split, canonical_url, ids). Documents may span blocks; the last block is padded.

    A document is sent as one slice for each block that it lies in, so what moves is a row for each slice, not for each token, and no row
    holds more of a document than its slice.
    """
    placed = docs.join(starts(docs.select("split", "canonical_url", F.size("ids").alias("n")), seed).drop("n"), ["split", "canonical_url"])
    ids, start = F.concat("ids", F.array(F.lit(end))), F.col("start")
    placed = placed.select("split", "start", ids.alias("ids"))

    def piece(block):  # of one document in one block
        begins = F.greatest(F.lit(0), block * length - start).cast("int")
        at = (start + begins - block * length).cast("int")
        return F.struct(block.alias("block"), F.struct(at.alias("at"), F.slice("ids", begins + 1, F.lit(length) - at).alias("ids")).alias("piece"))

    first, last = F.floor(start / length).cast("long"), F.floor((start + F.size("ids") - 1) / length).cast("long")
    pieces = placed.select("split", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("split", "p.block", "p.piece")
    blocks = pieces.groupBy("split", "block").agg(F.array_sort(F.collect_list("piece")).alias("x")).withColumn("x", F.flatten(F.transform("x", lambda p: p["ids"])))
    free = F.lit(length) - F.size("x")
    return blocks.select(
        "split", "block", F.concat(F.col("x").cast("array<int>"), F.array_repeat(F.lit(pad), free)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(True), F.size("x")), F.array_repeat(F.lit(False), free)).alias("attention_mask"),
    )


def pack_stats(docs: DataFrame, length: int) -> DataFrame:
    """Counts of the packed stream of docs(split, n)."""
    out = docs.groupBy("split").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("content_tokens"))
    out = out.withColumn("non_padding_tokens", F.col("content_tokens") + F.col("documents"))
    out = out.withColumn("blocks", F.ceil(F.col("non_padding_tokens") / length).cast("long"))
    return out.withColumn("padding_tokens", F.col("blocks") * length - F.col("non_padding_tokens")).withColumn("eos_tokens", F.col("documents"))


def labels(ids: Column, mask: Column) -> Column:
    """ids, -100 where the mask is false."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m, i).otherwise(-100))


def target_tokens(mask: Column) -> Column:
    """Masked-in places after the first."""
    return F.size(F.filter(F.slice(mask, F.lit(2), F.greatest(F.size(mask), F.lit(1))), lambda m: m))


def instruction_example(prompt: Column, answer: Column, end: int, length: int, strict: bool = True) -> Column:
    """Struct of ids and labels of prompt + answer + end token, cut at length; the prompt's labels are -100.

    strict: a prompt that leaves no place for an answer token fails the job; else all its labels are -100.
    """
    ids = F.slice(F.concat(prompt, answer, F.array(F.lit(end))), 1, length)
    p = F.least(F.size(prompt), F.lit(length))
    labels = F.concat(F.array_repeat(F.lit(-100), p), F.slice(ids, p + 1, F.greatest(F.size(ids) - p, F.lit(0))))
    if strict:
        labels = F.when(p < F.size(ids), labels).otherwise(F.raise_error(F.lit(f"no answer token is left within {length}")).cast("array<int>"))
    return F.struct(ids.alias("ids"), labels.alias("labels"))


def optimizer_steps(blocks: Column, micro_batch: int, accumulation: int, epochs: int) -> Column:
    """Whole accumulation rounds only."""
    return F.floor(blocks / (micro_batch * accumulation)).cast("long") * epochs


def running_ids(rows: DataFrame, group: str, order: str, prefix: str, column: str = "id") -> DataFrame:
    """prefix, group and a three-digit number that counts the group's rows in order."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn(column, F.format_string(f"{prefix}_%s_%03d", F.col(group), nth))


def template(pattern: str, **parts: Column) -> Column:
    """pattern with {name} replaced by columns; what a column holds is left as it is."""
    pieces = re.split(r"\{(" + "|".join(map(re.escape, parts)) + r")\}", pattern) if parts else [pattern]
    return F.concat(*(parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


__all__ = ["instruction_example", "labels", "optimizer_steps", "pack", "pack_stats", "running_ids", "starts", "target_tokens", "template", "token_ids", "vocabulary", "words"]
