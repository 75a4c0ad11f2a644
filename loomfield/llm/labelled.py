"""Labelled documents, held-out folds, and the number of ranges that documents are dealt into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.plans.shared import broadcast_if_small, materialize

FOLDS = 5
#: Narrow rows of so many documents at most are broadcast: about 100 bytes each.
MOST_SENT = 1_000_000

#: Bytes of text in a range, and the most ranges of a table; beyond, ranges grow, and tasks stream through them.
RANGE, MOST_RANGES = 16 << 20, 1 << 16


def ranges_for(docs: DataFrame, text: str) -> int:
    """The number of ranges with about RANGE bytes of text each."""
    return min(MOST_RANGES, 1 + (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // RANGE)


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold whose labels aren't learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_ids(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label), stored, of the labelled documents outside the held-out fold, without null labels.

    A document with several labels counts once, with the greatest.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return materialize(own.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")


def bounded(ids: DataFrame, most: int, seed: str) -> DataFrame:
    """most rows at most, chosen by a hash of their ids, so that reruns agree."""
    return ids if ids.count() <= most else ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def with_texts(ids: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more columns of docs, label). Texts move only if there are more labels than can be sent to all tasks."""
    return docs.select("doc_id", "text", *more).join(broadcast_if_small(ids, MOST_SENT), "doc_id")
