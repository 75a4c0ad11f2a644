"""Cleaning of raw documents: a reason for each rejected row, and two rounds of deduplication with preferred survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import text, urls
from loomfield.plans.shared import broadcast_if_small, materialize


def reason(content: Column, url: Column, least: int) -> Column:
    """The first rule that rejects a document; null if none does."""
    blank = lambda c: c.isNull() | (urls.strip(c) == "")
    return (
        F.when(blank(content), "missing_content")
        .when(blank(url), "missing_url")
        .when(urls.is_aggregate(url), "aggregate_document")
        .when(F.length(content) < least, "short_stub")
    )


def normalise(docs: DataFrame, exact: bool = False) -> DataFrame:
    """Adds canonical_url, content_length of the stripped content, and the digest of normalised content."""
    plain = text.normalise_exact(F.col("content")) if exact else text.collapse(F.col("content"))
    return docs.withColumns({
        "content_sha256": F.sha2(plain, 256),
        "canonical_url": urls.canonical_document(F.col("url")),
        "content": urls.strip(F.col("content")),
    }).withColumn("content_length", F.length("content"))


def survivors(docs: DataFrame, key: str, ordinal: str = "doc_id") -> DataFrame:
    """Adds survives: whether a row is its key's preferred one, Markdown before other, then longer, then the greater URL, then the lesser ordinal.

    The best row of a key is a maximum, which is taken in part before rows move, so a key that many rows share is no burden.
    """
    rank = F.struct(urls.is_markdown(F.col("url")), F.col("content_length"), F.col("url"), -F.col(ordinal))
    best = docs.groupBy(F.col(key).alias("__key")).agg(F.max(rank).alias("__best"))
    return docs.join(best, docs[key] == F.col("__key")).withColumn("survives", rank.eqNullSafe(F.col("__best"))).drop("__key", "__best")


def clean(raw: DataFrame, least: int = 800, exact: bool = False) -> DataFrame:
    """raw with reason: null for rows that stay. Wants url, content and doc_id, which tells rows apart.

    Only ids, URLs, lengths and digests go through deduplication; contents aren't moved for it.
    """
    judged = raw.withColumn("reason", reason(F.col("content"), F.col("url"), least))
    good = normalise(judged.where("reason is null").drop("reason"), exact)
    narrow = materialize(good.select("doc_id", "url", "content_sha256", "canonical_url", "content_length"), "clean")
    by_content = survivors(narrow, "content_sha256")
    by_url = survivors(by_content.where("survives").drop("survives"), "canonical_url")
    lost = [d.where("not survives").select(F.col("doc_id").alias("__id"), F.lit(why).alias("reason")) for d, why in ((by_content, "exact_content_duplicate"), (by_url, "canonical_url_duplicate"))]
    lost = broadcast_if_small(materialize(lost[0].unionByName(lost[1]), "clean-lost"), 2_000_000)
    kept = good.join(lost, good["doc_id"] == F.col("__id"), "left").drop("__id")
    return kept.unionByName(judged.where("reason is not null"), allowMissingColumns=True)


def excluded(raw: DataFrame, least: int = 800, exact: bool = False) -> DataFrame:
    """Rejected rows with what identifies them."""
    out = clean(raw, least, exact).where("reason is not null")
    content, url = F.coalesce("content", F.lit("")), F.coalesce("url", F.lit(""))
    plain = text.normalise_exact(content) if exact else text.collapse(content)
    return out.select(
        "doc_id", "reason", url.alias("url"), F.when(url == "", "").otherwise(urls.canonical_document(url)).alias("canonical_url"),
        F.coalesce("seed_name", F.lit("unknown")).alias("seed_name"), F.length(content).cast("int").alias("content_length"), F.sha2(plain, 256).alias("content_sha256"),
    )


def short_id(canonical_url: Column) -> Column:
    return F.substring(F.sha2(canonical_url, 256), 1, 16)


def patched(rows: DataFrame, fixes: DataFrame, key: str, column: str, most: int = 1000) -> DataFrame:
    """rows with column replaced where fixes(key, value) has the key.

    Raises if a key of fixes isn't in rows or has several values, if a key is there twice in rows, or if a value of column is longer than most.
    """
    f = fixes.select(F.col(key).alias("__k"), F.col("value").alias("__v"))
    out = rows.join(broadcast_if_small(f, 100_000), rows[key] == F.col("__k"), "left").withColumn(column, F.coalesce("__v", column)).drop("__k", "__v")
    checks = {
        "fixes that no row has": f.join(rows.select(F.col(key).alias("__k")), "__k", "left_anti").select("__k"),
        "keys with several fixes": f.groupBy("__k").count().where("count > 1").select("__k"),
        "keys that are there twice": rows.groupBy(key).count().where("count > 1").select(key),
        f"values of {column} over {most} characters": out.where(F.length(column) > most).select(key),
    }
    for what, bad in checks.items():
        if some := [str(r[0]) for r in bad.limit(5).collect()]:
            raise ValueError(f"{what}: {', '.join(some)}")
    return out
