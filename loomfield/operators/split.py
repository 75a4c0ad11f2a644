"""Leak-free train and test splits by source, towards a share of tokens."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text
from loomfield.plans.shared import broadcast_if_small, materialize, ship


def flag_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs with qa_source: whether sources(canonical_url) has their URL."""
    known = sources.select(F.col("canonical_url").alias("__u")).distinct()
    joined = docs.join(broadcast_if_small(known, 1_000_000), docs["canonical_url"] == F.col("__u"), "left")
    return joined.withColumn("qa_source", F.col("__u").isNotNull()).drop("__u")


def hash_split(docs: DataFrame, seed: int = 42, ratio: float = 0.25) -> DataFrame:
    """docs with initial_test: a hash below ratio, never none and never all of a source's candidates, which are those without qa_source.

    A source with fewer than two candidates has none. Wants seed_name, canonical_url, qa_source.
    """
    by = ["seed_name", "qa_source"]
    out = docs.withColumn("fraction", text.stable_fraction(text.source_seed(seed, F.col("seed_name")), F.col("canonical_url")))
    place, low = F.struct("fraction", "canonical_url"), F.col("fraction") < ratio
    found = out.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(low.cast("long")).alias("__lows"), F.min(place).alias("__first"), F.max(place).alias("__last"))
    found = found.select(*(F.col(c).alias(f"__{c}") for c in by), "__n", "__lows", "__first", "__last")
    out = out.join(broadcast_if_small(found, 100_000), out["seed_name"].eqNullSafe(F.col("__seed_name")) & out["qa_source"].eqNullSafe(F.col("__qa_source")))
    low = F.when(F.col("__lows") == 0, place == F.col("__first")).when(F.col("__lows") == F.col("__n"), place != F.col("__last")).otherwise(low)
    return out.withColumn("initial_test", ~F.col("qa_source") & (F.col("__n") >= 2) & low).drop("__n", "__lows", "__first", "__last", "__seed_name", "__qa_source")


class _Unknown(Exception):
    """A move depends on a URL that wasn't given."""


class _Side:
    """The documents on one side of a split, by token count: how many there are and the first URLs."""

    def __init__(self):
        self.sizes: list[int] = []
        self.left: dict[int, int] = {}
        self.urls: dict[int, list[str]] = {}
        self.hidden: dict[int, int] = {}  # documents whose URLs come after all given ones

    def add(self, size: int, n: int, urls: list[str]) -> None:
        insort(self.sizes, size)
        self.left[size], self.urls[size], self.hidden[size] = n, sorted(urls), n - len(urls)

    def first(self, size: int) -> str:
        urls = self.urls[size]
        if not urls or self.hidden[size] and urls[0] > self.last[size]:
            raise _Unknown
        return urls[0]

    def known(self) -> None:
        self.last = {size: urls[-1] if urls else "" for size, urls in self.urls.items()}

    def nearest(self, size: int) -> tuple[int, str, int] | None:
        """(distance, URL, size) of the document whose token count is nearest to size; the first URL wins ties."""
        at = bisect_left(self.sizes, size)
        near = [self.sizes[i] for i in (at - 1, at) if 0 <= i < len(self.sizes)]
        if len(near) == 2 and size - near[0] != near[1] - size:
            near = [min(near, key=lambda x: abs(x - size))]
        return min(((abs(x - size), self.first(x), x) for x in near), default=None)

    def take(self, size: int, url: str) -> None:
        self.urls[size].remove(url)
        self.left[size] -= 1
        if not self.left[size]:
            self.sizes.remove(size)

    def put(self, size: int, url: str) -> None:
        if size not in self.left or not self.left[size]:
            insort(self.sizes, size)
        self.left[size] = self.left.get(size, 0) + 1
        insort(self.urls.setdefault(size, []), url)
        self.hidden.setdefault(size, 0)
        self.last.setdefault(size, "")


def _towards(target: int, inside: _Side, outside: _Side) -> set[str]:
    """URLs that change sides when the one document that brings the total inside nearest to target moves, again and again, as long as one does."""
    total, n, changed = sum(s * k for s, k in inside.left.items()), sum(inside.left.values()), set()
    inside.known()
    outside.known()
    while True:
        gap = target - total
        best = outside.nearest(gap) if gap > 0 else inside.nearest(-gap) if n > 1 else None
        if best is None or best[0] >= abs(gap):
            return changed
        _, url, size = best
        old, new = (outside, inside) if gap > 0 else (inside, outside)
        old.take(size, url)
        new.put(size, url)
        n, total = (n + 1, total + size) if gap > 0 else (n - 1, total - size)
        changed ^= {url}


def _repair(ratio: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        source, inside, outside = rows["seed_name"].iloc[0], _Side(), _Side()
        for r in rows.itertuples():
            (inside if r.initial_test else outside).add(int(r.size_), int(r.n), list(r.urls))
        try:
            changed, more = _towards(round(int(rows["total"].iloc[0]) * ratio), inside, outside), False
        except _Unknown:
            changed, more = [None], True
        return pd.DataFrame({"seed_name": pd.Series([source] * len(changed), dtype=object), "canonical_url": pd.Series(sorted(changed) if not more else changed, dtype=object), "more": pd.Series([more] * len(changed), dtype=bool)})

    return run


#: First URLs of each token count that a source's moves are worked out with, and times as many where they don't suffice.
URLS, TIMES = 4, 8


def split(docs: DataFrame, seed: int = 42, ratio: float = 0.25) -> DataFrame:
    """docs with split, the greedy repair of hash_split towards ratio of a source's tokens.

    The moves of a source are one sequence, but they depend only on how many documents of each token count are on either side, and on
    the first URLs of a token count for ties. Those are aggregated, and one task works a source's moves out of them: a row for each distinct
    token count and side, whatever the number of documents. Where a source moves more documents of one token count
    than it was given URLs of, it is done again with more. Documents that change sides are joined back by URL.

    Cases: URLs are unique; a null token count is 0; a null source is a source.
    """
    ship(docs.sparkSession)
    start = materialize(hash_split(docs, seed, ratio), "hash-split")
    every = start.groupBy("seed_name").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("total"), F.count_if(~F.col("qa_source")).alias("free")).where("free >= 2").drop("free")
    free = start.where(~F.col("qa_source")).select("seed_name", F.coalesce("token_count", F.lit(0)).alias("size_"), "initial_test", "canonical_url")
    side = ["seed_name", "size_", "initial_test"]
    sizes = free.groupBy(*side).agg(F.count("*").alias("n"))
    moves, urls, todo = None, URLS, every
    while True:
        nth = F.row_number().over(Window.partitionBy(*side).orderBy("canonical_url"))
        first = free.withColumn("nth", nth).where(F.col("nth") <= urls).groupBy(*side).agg(F.collect_list("canonical_url").alias("urls"))
        given, some = first.select(*(F.col(c).alias(f"_{c}") for c in side), "urls"), todo.select(F.col("seed_name").alias("_source"), "total")
        rows = sizes.join(given, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in side)))
        rows = rows.join(broadcast_if_small(some, 100_000), F.col("seed_name").eqNullSafe(F.col("_source"))).select(*side, "n", "urls", "total")
        got = materialize(rows.groupBy("seed_name").applyInPandas(_repair(ratio), "seed_name string, canonical_url string, more boolean"), "moves")
        done = got.where("not more").select("canonical_url")
        moves = done if moves is None else moves.unionByName(done)
        more = got.where("more").select(F.col("seed_name").alias("_again"))
        if more.isEmpty():
            break
        todo, urls = every.join(more, F.col("seed_name").eqNullSafe(F.col("_again"))).drop("_again"), urls * TIMES
    moved = moves.select(F.col("canonical_url").alias("_moved"))
    out = start.join(moved, F.col("canonical_url") == F.col("_moved"), "left")
    return out.withColumn("split", F.when(F.col("initial_test") != F.col("_moved").isNotNull(), "test").otherwise("train")).drop("_moved")


def split_stats(docs: DataFrame) -> DataFrame:
    """Documents, characters, tokens and QA sources by split and source, with totals by split (source null)."""
    out = docs.groupBy(F.col("split"), F.col("seed_name")).agg(
        F.count("*").alias("documents"), F.sum("content_length").alias("characters"), F.sum("token_count").alias("content_tokens"), F.sum(F.col("qa_source").cast("long")).alias("qa_source_documents")
    )
    total = out.groupBy("split").agg(*(F.sum(c).alias(c) for c in ("documents", "characters", "content_tokens", "qa_source_documents")))
    return out.unionByName(total.withColumn("seed_name", F.lit(None).cast("string")))


def leaks(docs: DataFrame) -> DataFrame:
    """URLs in both splits, and QA sources in test: none should be left."""
    both = docs.groupBy("canonical_url").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("url_in_both_splits").alias("rule"), "canonical_url")
    test = docs.where("qa_source and split = 'test'").select(F.lit("qa_source_in_test").alias("rule"), "canonical_url")
    return both.unionByName(test)
