"""Metrics of model answers and of blind judging, in long form: (id, model, value)."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text, twister
from loomfield.functions.urls import strip
from loomfield.plans.prefix import prefix_in_groups
from loomfield.plans.shared import broadcast_if_small, materialize, ship, spread

#: Fixed values of the paired bootstrap.
SEED, RESAMPLES = 20260815, 20_000
#: Words of the generator drawn at once.
DRAWS = 1 << 20
#: Words of a segment of the sequence at least, and segments of a cell at most.
SEGMENT, SEGMENTS = 1 << 24, 1_024
#: Deltas of a stored row at most: Spark sends some 10,000 rows at once to Python. Deltas and cells, about, that a task draws for at once.
CHUNK, BUNDLE, BUNDLED = 128, 1 << 23, 64
#: Keywords sent to all tasks at once, and characters of all of those, each a node of some 50 bytes at most.
KEYWORDS, KEYWORD_CHARS = 100_000, 1 << 20


def answer_metrics(answers: DataFrame, qa: DataFrame, normal: Callable[[Column], Column] = text.alnum) -> DataFrame:
    """Rates by model of answers(id, model, answer) against qa(id, answer, keywords). Keywords are counted apart, so rows don't fan out."""
    both = answers.select("id", "model", "answer").join(qa.select("id", F.col("answer").alias("reference"), "keywords"), "id")
    flag = lambda c: F.avg(c.cast("double"))
    rows = both.groupBy("model").agg(
        F.count("*").alias("items"), flag(strip(F.col("answer")) != "").alias("nonempty_rate"), flag(F.length("answer") <= 100).alias("under_100_chars_rate"),
        F.avg(F.length("answer")).alias("average_answer_chars"), flag(normal(F.col("answer")) == normal(F.col("reference"))).alias("normalized_exact_match_rate"),
    )
    each = both.select("model", normal(F.col("answer")).alias("a"), F.explode("keywords").alias("k"))
    hits = each.groupBy("model").agg(F.count("*").alias("keyword_total"), F.sum(F.contains("a", normal(F.col("k"))).cast("long")).alias("keyword_hits"))
    out = rows.join(hits, "model", "left").fillna(0, ["keyword_total", "keyword_hits"])
    return out.withColumn("keyword_recall", F.coalesce(F.try_divide("keyword_hits", "keyword_total"), F.lit(0.0)))


def duplicate_questions(qa: DataFrame, most: int = 10) -> DataFrame:
    return qa.groupBy("question").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "question").limit(most)


def continuations(answers: DataFrame, marker: str = "question:", after: int = 20) -> DataFrame:
    """Answers by model that go on with another question."""
    found = F.contains(F.substring(F.lower("answer"), after + 1, 2**31 - 1), F.lit(marker))
    return answers.groupBy("model").agg(F.sum(found.cast("long")).alias("continuations"), F.sum((strip(F.col("answer")) != "").cast("long")).alias("nonempty"))


def pairwise_matches(answers: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Ids where two models answer alike, for each pair; an answer that isn't there is like none."""
    wide = answers.groupBy("id").pivot("model", sorted({m for p in pairs for m in p})).agg(F.first("answer"))
    each = F.array(*(F.struct(F.lit(f"{a}__{b}").alias("pair"), F.coalesce(F.col(a) == F.col(b), F.lit(False)).alias("same")) for a, b in pairs))
    return wide.select(F.inline(each)).groupBy("pair").agg(F.sum(F.col("same").cast("long")).alias("matches"))


def combined(answers: DataFrame) -> DataFrame:
    """One row an id with a map of its models' answers, models in order."""
    return answers.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "answer")))).alias("answers"))


def separate(wide: DataFrame) -> DataFrame:
    return wide.select("id", F.explode("answers").alias("model", "answer"))


#: Ranges that a group's values are cut into, and distinct values that are sorted in one task.
CUTS, SORTED = 1_024, 10_000
#: Groups of so many at most are sent to all tasks, some 200 bytes each.
MOST_GROUPS = 100_000


def at_ranks(values: DataFrame, value: str, by: tuple[str, ...], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and, for each name in ranks, the value at a rank, from 1, which is a function of the number of values that aren't null.

    Values are numbers. They are counted before anything else. While the values that may hold a rank are more than SORTED, they are cut into
    CUTS ranges between their least and greatest, the ranges are counted, and only the one with the rank is kept: a round reads
    counts, and what goes through a window is a row for each range. The few values left are sorted. So no task or buffer holds a
    group's values, be it one of all rows.

    Cases: nulls don't count; groups, which may be null, without a value aren't there; equal values take as many ranks as there are.
    """
    made = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = materialize(values.where(F.col(value).isNotNull()).select(made.alias("g"), F.col(value).alias("v")).groupBy("g", "v").agg(F.count("*").alias("m")), "counts")
    groups = counts.groupBy("g").agg(F.sum("m").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("d"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()))
    sought = materialize(groups.select("g", "low", "high", "d", F.lit(0).cast("long").alias("before"), F.inline(wanted)), "ranks")
    own = Window.partitionBy("g", "name")

    def within(some: DataFrame) -> DataFrame:
        return counts.join(broadcast_if_small(some, MOST_GROUPS), "g").where(F.col("v").between(F.col("low"), F.col("high")))

    largest = sought.agg(F.max("d")).first()[0] or 0
    while largest > SORTED:
        many = sought.where(F.col("d") > SORTED)
        span = F.col("high").cast("double") - F.col("low").cast("double")
        cut = F.least(F.lit(CUTS - 1), F.floor(F.coalesce(F.try_divide(F.col("v").cast("double") - F.col("low").cast("double"), span), F.lit(0.0)) * CUTS))
        cuts = within(many).groupBy("g", "name", "rank", "before", cut.alias("cut")).agg(F.sum("m").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("d"))
        cuts = cuts.withColumn("upto", F.col("before") + F.sum("m").over(own.orderBy("cut"))).where(F.col("upto") >= F.col("rank"))
        first = cuts.withColumn("nth", F.row_number().over(own.orderBy("cut"))).where("nth = 1")
        first = first.select("g", "low", "high", "d", (F.col("upto") - F.col("m")).alias("before"), "name", "rank")
        sought = materialize(first.unionByName(sought.where(F.col("d") <= SORTED)), "ranks")
        last, largest = largest, sought.agg(F.max("d")).first()[0]
        if largest == last:  # distinct numbers that are one as doubles
            break
    upto = F.col("before") + F.sum("m").over(own.orderBy("v"))
    found = within(sought).withColumn("upto", upto).where(F.col("upto") >= F.col("rank")).groupBy("g", "name").agg(F.min("v").alias("v"))
    wide = found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    return wide.select(*(F.col("g")[c].alias(c) for c in by), *ranks)


def halves_of(names: tuple[str, str] = ("lower", "upper")) -> dict[str, Callable[[Column], Column]]:
    """The ranks of the two middle values, which are one where the number of values is odd."""
    return {names[0]: lambda n: F.floor((n + 1) / 2), names[1]: lambda n: F.floor(n / 2) + 1}


def middle(lower: str = "lower", upper: str = "upper") -> Column:
    """The interpolated median of the values at the ranks of halves_of()."""
    return F.col(lower) + (F.col(upper) - F.col(lower)) * 0.5


def nearest_rank_of(q: float) -> Callable[[Column], Column]:
    """Rank ceil(q n), 1 at least."""
    return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(q) * n))


def floor_rank_of(p: int) -> Callable[[Column], Column]:
    """Rank floor(n p / 100) + 1, n at most."""
    return lambda n: F.least(n, F.floor(n * p / F.lit(100)) + 1)


def lengths(values: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, interpolated median and floor-index 95th percentile."""
    out = values.groupBy(group).agg(F.avg(value).alias("mean"))
    ranks = at_ranks(values, value, (group,), {**halves_of(), "p95": floor_rank_of(95)})
    ranks = ranks.select(F.col(group).alias("__g"), middle().alias("median"), "p95")
    return out.join(ranks, out[group].eqNullSafe(F.col("__g")), "left").drop("__g")


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation from centred sums; NaN where a side doesn't vary."""
    w = Window.partitionBy(*by)
    d = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = d.withColumns({"dx": F.col("x") - F.avg("x").over(w), "dy": F.col("y") - F.avg("y").over(w)}) if by else _centred(d)
    sums = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("dx") * F.col("dy")).alias("num"), F.sqrt(F.sum(F.col("dx") ** 2) * F.sum(F.col("dy") ** 2)).alias("den"))
    return sums.select(*by, "n", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(float("nan"))).alias("r"))


def _centred(d: DataFrame) -> DataFrame:
    means = d.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return d.join(F.broadcast(means)).select("x", "y", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy"))


def deltas(scores: DataFrame, splits: DataFrame, comparisons: list[tuple[str, str]]) -> DataFrame:
    """split, comparison, judge, id, delta: the second model's score less the first's. splits(id, split) may overlap."""
    wide = scores.groupBy("judge", "id").pivot("model", sorted({m for c in comparisons for m in c})).agg(F.first("score"))
    each = F.array(*(F.struct(F.lit(f"{a}__to__{b}").alias("comparison"), (F.col(b) - F.col(a)).cast("double").alias("delta")) for a, b in comparisons))
    return wide.join(splits, "id").select("split", "judge", "id", F.inline(each))


def paired(d: DataFrame) -> DataFrame:
    """Mean, wins, losses and ties of deltas."""
    n = lambda c: F.sum(c.cast("long"))
    return d.groupBy("split", "comparison", "judge").agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), n(F.col("delta") > 0).alias("wins"), n(F.col("delta") < 0).alias("losses"), n(F.col("delta") == 0).alias("ties")
    )


def accepted(words: np.random.Generator, n: int, most: int | None = None) -> Iterator[np.ndarray]:
    """What random.Random.randrange(n) gives of the next words: their high bits, where those are below n. most: the words that are drawn."""
    shift, left = np.uint32(32 - n.bit_length()), most
    while left is None or left > 0:
        at = words.integers(0, 1 << 32, DRAWS if left is None else min(DRAWS, left), dtype=np.uint32) >> shift
        left = None if left is None else left - len(at)
        yield at[at < n]


def resampled_means(x: list[float], words: np.random.Generator, resamples: int, skip: int = 0) -> list[float]:
    """sum(x[draw(n)] for _ in range(n)) / n again and again, n = len(x) and draw() being randrange(n) on these words, after skip draws."""
    return stacked_means([np.array(x, float)], words, resamples, skip)[0]


def packed(x: np.ndarray) -> np.ndarray:
    """x as the smallest whole numbers that hold it, if sums of as many of those are exact in any order."""
    whole = bool((x == np.rint(x)).all() and np.abs(x).sum() < 2.0**53 / len(x))
    kinds = [k for k in (np.int8, np.int16, np.int32, np.int64) if whole and -np.iinfo(k).max <= x.min() and x.max() <= np.iinfo(k).max]
    return x.astype(kinds[0]) if whole else x


def stacked_means(cells: list[np.ndarray], words: np.random.Generator, resamples: int, skip: int = 0) -> list[list[float]]:
    """resampled_means of cells of one size, from the same draws."""
    n, stack = len(cells[0]), list(map(packed, cells))
    out, open_, held = [[] for _ in cells], [0] * len(cells), []  # sums of whole numbers, or the draws, of a resample that is begun
    have = 0
    for at in accepted(words, n):
        skip, at = max(0, skip - len(at)), at[skip:].astype(np.intp)
        if not len(at):
            continue
        ends = np.arange(n - have, len(at) + 1, n)
        begins = np.concatenate([[0], ends[ends < len(at)]])
        parts = np.split(at, begins[1:]) if any(x.dtype == float for x in stack) else []
        for c, x in enumerate(stack):
            if x.dtype != float:
                sums = np.add.reduceat(x[at], begins, dtype=np.int64)
                sums[0] += open_[c]
                out[c] += (sums[: len(ends)] / n).tolist()
                open_[c] = int(sums[-1]) if len(begins) > len(ends) else 0
                continue
            for k in range(min(len(ends), resamples - len(out[c]))):  # added one by one in their order
                out[c].append(sum(chain.from_iterable(x[p].tolist() for p in ([*held, parts[k]] if k == 0 else [parts[k]]))) / n)
        if parts:
            held = ([] if len(ends) else held) + (parts[len(ends) :] or [])
        have = len(at) - int(ends[-1]) if len(ends) else have + len(at)
        if all(len(m) >= resamples for m in out):
            return [m[:resamples] for m in out]


def bootstrap(d: DataFrame, seed: int = SEED, resamples: int = RESAMPLES) -> DataFrame:
    """A 95 % interval of the mean delta by resampling ids in their order, and whether it leaves out 0.

    All resamples of a cell take draws from one sequence of words. It is cut into segments, which tasks reach by jumping ahead. They first count the
    draws of each segment; sums of those tell in which segment a resample begins and after how many draws, so the resamples, too, are dealt over tasks.
    The result doesn't depend on how. Deltas are numbered by ranges of ids and stored in chunks; chunks, a few kilobytes a row, go to every task that
    draws from their cell. Cells of one size take the same draws, so they are drawn together. A task holds the deltas of one bundle of cells,
    BUNDLE in all or one cell, in a byte each where they are small whole numbers.

    Cases: null deltas don't count, and a cell without others isn't there; ids are unique in a cell.
    """
    spark = d.sparkSession
    ship(spark)
    by = ["split", "comparison", "judge"]
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in by)
    tasks = spark.sparkContext.defaultParallelism
    rows = d.where("delta is not null").select(F.struct(*by).alias("g"), "id", F.col("delta").cast("double").alias("delta"), F.lit(1).alias("one"))
    ranged = rows.repartitionByRange(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "deltas")
    cells = materialize(ranged.groupBy("g").agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("n").agg(F.greatest(F.ceil(F.count("*") * F.col("n") / F.lit(BUNDLE)), F.ceil(F.count("*") / F.lit(BUNDLED))).cast("long").alias("bundles"))
    bits = F.length(F.conv(F.col("n").cast("string"), 10, 2))
    every = (F.lit(float(resamples)) * F.pow(F.lit(2.0), bits)).cast("long")  # words that all resamples take, as expected
    length = F.greatest(F.lit(SEGMENT), F.ceil(every / SEGMENTS)).cast("long")
    plan = sizes.select("n", "bundles", length.alias("length"), F.ceil(every / length).cast("int").alias("segments"))
    numbered = prefix_in_groups(ranged, "g", "part", ["id"], "one", "at").withColumn("chunk", F.floor(F.col("at") / CHUNK))
    chunks = numbered.groupBy("g", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "delta"))).alias("x"))
    chunks = materialize(chunks.select("g", "chunk", F.col("x.delta").alias("values")), "chunks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = twister.seeded(seed)
        for batch in batches:
            n, length, segment = (batch.column(i).to_pylist() for i in range(3))
            found = [sum(map(len, accepted(twister.generator(twister.jumped(state, k * size)), m, size))) for m, size, k in zip(n, length, segment)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["n", "length", "segment", "draws"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = twister.seeded(seed)

        def drawn(work: tuple, some: list) -> Iterator[pa.RecordBatch]:
            _, first, last, word, skip = work
            got = stacked_means([packed(np.concatenate(x)) for _, x in some], twister.generator(twister.jumped(state, word)), last - first, skip)
            for (own, _), m in zip(some, got):
                yield pa.RecordBatch.from_arrays([*own, pa.array([m], pa.list_(pa.float64()))], names=[*by, "means"])

        now, some = None, []
        for batch in batches:
            work = list(zip(*(batch.column(c).to_pylist() for c in ("bundle", "first", "last", "word", "skip"))))
            for i, k in enumerate(batch.column("chunk").to_pylist()):
                if k == 0:  # the first of a cell
                    if some:
                        some[-1][1][:] = [packed(np.concatenate(some[-1][1]))]
                    if some and work[i] != now:
                        yield from drawn(now, some)
                        some = []
                    now = work[i]
                    some.append(([pa.concat_arrays([batch.column(c).slice(i, 1)]) for c in by], []))
                some[-1][1].append(batch.column("values").slice(i, 1).flatten().to_numpy().copy())
        if some:
            yield from drawn(now, some)

    each = plan.where("segments > 1").select("n", "length", F.explode(F.sequence(F.lit(0), F.col("segments") - 2)).alias("segment"))  # none begins after the last
    counts = materialize(each.repartition(4 * tasks, "n", "segment").mapInArrow(count, "n long, length long, segment int, draws long"), "draws")
    sums = F.coalesce(F.sum("draws").over(Window.partitionBy("n").orderBy("segment")), F.lit(0))
    begins = counts.withColumn("before", sums).groupBy("n").agg(F.array_sort(F.collect_list("before")).alias("b"))  # SEGMENTS entries at most
    pieces = F.least(F.col("segments"), F.lit(2 * tasks))
    before = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("b", F.array().cast("array<long>")))
    begins = plan.join(begins, "n", "left").select("n", "bundles", "length", pieces.alias("pieces"), before.alias("before"))
    at = lambda k: F.floor(k * F.lit(resamples) / F.col("pieces")).cast("int")
    parts = begins.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns({"first": at(F.col("piece")), "last": at(F.col("piece") + 1)}).where("last > first")
    passed = F.filter("before", lambda x: x <= F.col("first") * F.col("n"))
    parts = parts.select("n", "bundles", "first", "last", ((F.size(passed) - 1) * F.col("length")).alias("word"), (F.col("first") * F.col("n") - F.element_at(passed, -1)).alias("skip"))
    parts = materialize(parts, "pieces")
    work = chunks.join(cells, "g").join(broadcast_if_small(parts, MOST_GROUPS), "n").withColumn("bundle", F.concat_ws(":", "n", F.pmod(F.xxhash64("g"), F.col("bundles"))))
    dealt = work.select("g.*", "bundle", "first", "last", "word", "skip", "chunk", "values").repartition(8 * tasks, "bundle", "first").sortWithinPartitions("bundle", "first", *by, "chunk")
    drawn = dealt.mapInArrow(means, f"{kinds}, means array<double>")
    sorted_ = drawn.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("means"))).alias("m"))
    low, high = (F.col("m")[int(q * resamples)] for q in (0.025, 0.975))
    return sorted_.select(*by, low.alias("ci95_low"), high.alias("ci95_high"), ((low > 0) | (high < 0)).alias("significant"))


def concordance(cells: DataFrame) -> DataFrame:
    """Cells of (split, comparison) where all judges agree on significance, and where they don't."""
    each = cells.groupBy("split", "comparison").agg((F.count_distinct("significant") == 1).alias("agree"))
    return each.agg(F.coalesce(F.sum(F.col("agree").cast("long")), F.lit(0)).alias("agreeing"), F.coalesce(F.sum((~F.col("agree")).cast("long")), F.lit(0)).alias("disagreeing"))


def blind_map(items: DataFrame, models: list[str], seed: int) -> DataFrame:
    """id, letter, model: each item's own shuffle of the models, by Python's generator seeded from a digest of seed and id."""
    ship(items.sparkSession)
    letters = [chr(65 + i) for i in range(len(models))]

    @F.pandas_udf("array<string>")
    def shuffled(ids: pd.Series) -> pd.Series:
        def one(i):
            order = list(models)
            random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big")).shuffle(order)
            return order

        return ids.map(one)

    return items.select("id", F.explode(F.arrays_zip(F.array(*map(F.lit, letters)).alias("letter"), shuffled(F.col("id").cast("string")).alias("model"))).alias("x")).select("id", "x.letter", "x.model")


def hashed_map(items: DataFrame, models: list[str], seed: int) -> DataFrame:
    """Like blind_map with another permutation: models in the order of a digest of seed, id and model. Letters, as there, are the characters from A on."""
    m = items.select("id", F.explode(F.array(*map(F.lit, models))).alias("model"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), "model"), 256), "model"))
    return m.select("id", F.chr((F.lit(64) + nth).cast("long")).alias("letter"), "model")


def position_balance(mapping: DataFrame, models: list[str]) -> DataFrame:
    return mapping.groupBy("letter").pivot("model", models).agg(F.count(F.lit(1))).na.fill(0)


def unblinded(judgements: DataFrame, mapping: DataFrame) -> DataFrame:
    """id, model, score, winner_model of judgements(id, winner, scores map letter to score); winner is a letter or Tie."""
    each = judgements.select("id", "winner", F.explode("scores").alias("letter", "score")).join(mapping, ["id", "letter"])
    won = mapping.select("id", F.col("letter").alias("winner"), F.col("model").alias("winner_model"))
    return each.join(won, ["id", "winner"], "left").withColumn("winner_model", F.coalesce("winner_model", F.lit("Tie"))).select("id", "model", "score", "winner_model")


def standings(scores: DataFrame, models: list[str]) -> DataFrame:
    """Wins and mean score by model, with a row for ties; models that never occur have 0 wins."""
    names = scores.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, [*models, "Tie"]))).alias("model"))
    wins = scores.select("id", F.col("winner_model").alias("model")).distinct().groupBy("model").agg(F.count("*").alias("wins"))
    means = scores.groupBy("model").agg(F.avg("score").alias("mean_score"))
    return names.join(wins, "model", "left").join(means, "model", "left").fillna(0, ["wins"])


def ranking(scores: DataFrame, *by: str) -> DataFrame:
    """Mean score, wins with and without shared ones, and rank by mean, of scores(id, model, score), by subset if columns of scores name one.

    An id's scores are reduced to its best one and how many models have it before they meet them again; models are as many as are named.
    """
    best = scores.groupBy(*by, "id").agg(F.max("score").alias("best"))
    top = scores.join(best, [*by, "id"]).withColumn("top", (F.col("score") == F.col("best")).cast("long"))
    shared = top.where("top = 1").groupBy(*by, "id").agg(F.sum("top").alias("tops"))
    top = top.join(shared, [*by, "id"], "left")
    out = top.groupBy(*by, "model").agg(F.avg("score").alias("mean_score"), F.sum("top").alias("wins_with_ties"), F.sum(((F.col("top") == 1) & (F.col("tops") == 1)).cast("long")).alias("unique_wins"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_score"), "model")))


def subset_deltas(scores: DataFrame, subsets: DataFrame, versions: dict[str, str]) -> DataFrame:
    """subset, model, source, items, mean_score, good_mean, delta: how far a model's mean score is from that of the model it was made from.

    scores(id, model, score), subsets(id, subset, good), which may overlap; versions names a model's source. delta is over the ids that both have,
    good_mean over ids with a good reference; both are null without any.
    """
    each = scores.join(subsets, "id")
    means = each.groupBy("subset", "model").agg(F.count("*").alias("items"), F.avg("score").alias("mean_score"), F.avg(F.when(F.col("good"), F.col("score"))).alias("good_mean"))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(s).alias("source")) for m, s in sorted(versions.items()))))
    named = scores.sparkSession.range(1).select(pairs.alias("p")).select("p.model", "p.source")  # as many rows as models
    own = each.join(F.broadcast(named), "model").select("subset", "id", "model", "source", "score")
    base = scores.select("id", F.col("model").alias("source"), F.col("score").alias("source_score"))
    both = own.join(base, ["id", "source"]).groupBy("subset", "model", "source").agg(F.avg(F.col("score") - F.col("source_score")).alias("delta"))
    return means.join(F.broadcast(named), "model").join(both, ["subset", "model", "source"], "left").select("subset", "model", "source", "items", "mean_score", "good_mean", "delta")


def judge_problems(raw: Column, letters: list[str]) -> Column:
    """What is wrong with a judge's JSON: the winner, the keys of scores, a score that is no number from 1 to 10, or an empty reason."""
    names = [f"Candidate {x}" for x in letters]
    j = F.try_parse_json(raw) if hasattr(F, "try_parse_json") else F.parse_json(raw)
    get = lambda path, kind: F.try_variant_get(j, path, kind)
    scores = F.get_json_object(raw, "$.scores")
    keys = F.json_object_keys(scores)
    values = [F.schema_of_variant(F.try_variant_get(j, f"$.scores['{n}']", "variant")) for n in names]
    bad = F.lit(False)
    for n, kind in zip(names, values):
        number = get(f"$.scores['{n}']", "double")
        bad = bad | ~F.coalesce(number.between(1, 10) & ~kind.isin("BOOLEAN", "STRING"), F.lit(False))
    rules = {
        "winner": ~F.coalesce(get("$.winner", "string").isin(*names, "Tie"), F.lit(False)),
        "score_keys": ~F.coalesce(F.sort_array(keys) == F.array(*map(F.lit, sorted(names))), F.lit(False)),
        "score_values": bad,
        "reason": F.coalesce(strip(get("$.reason", "string")), F.lit("")) == "",
    }
    return F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))


def overlapping(keyword: str) -> bool:
    """Whether two occurrences of keyword can overlap: whether it begins as it ends."""
    return any(keyword.startswith(keyword[i:]) for i in range(1, len(keyword)))


def occurrences_in(corpus: DataFrame, keywords: list[str]) -> DataFrame:
    """k, n: occurrences of each keyword, from the left and without overlaps in a text, summed over all texts of corpus(text) that aren't null.

    The stated keywords are one Aho-Corasick automaton in every task, so a text is read once whatever their number. It meets all
    occurrences; of keywords that can overlap themselves, those that begin within the last one counted are left out. The empty keyword is at every place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found, length = ahocorasick.Automaton(), [len(k) for k in keywords]
        for i, k in enumerate(keywords):
            if k:
                found.add_word(k, i)
        found.make_automaton()
        some = len(found) > 0
        watched = {i for i, k in enumerate(keywords) if overlapping(k)}
        total, places = [0] * len(keywords), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is None:
                    continue
                places += len(text) + 1
                ends: dict[int, int] = {}  # of the last occurrence counted
                for end, i in found.iter(text) if some else ():
                    if i in watched:
                        if end - length[i] < ends.get(i, -1):
                            continue
                        ends[i] = end
                    total[i] += 1
        total = [n if k else places for k, n in zip(keywords, total)]
        yield pa.RecordBatch.from_arrays([pa.array(keywords, pa.string()), pa.array(total, pa.int64())], names=["k", "n"])

    return spread(corpus.select("text")).mapInArrow(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))


def exposure(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, min_occurrences, total_occurrences and log1p of both, of items(id, keywords) in corpus(text); items without keywords have no row."""
    each = items.select("id", F.explode("keywords").alias("k"))
    keywords = materialize(each.select("k").distinct(), "keywords")
    size = keywords.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("k")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size.n // KEYWORDS), -(-size.chars // KEYWORD_CHARS))
    counted = None
    for i in range(n):  # a stated set of keywords against all texts, in parts of bounded size
        part = sorted(r.k for r in keywords.where((F.pmod(F.xxhash64("k"), F.lit(n)) == i) & F.col("k").isNotNull()).collect())
        got = occurrences_in(corpus, part)
        counted = got if counted is None else counted.unionByName(got)
    each = each.join(counted, "k", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    out = each.groupBy("id").agg(F.min("n").alias("min_occurrences"), F.sum("n").alias("total_occurrences"))
    return out.withColumns({f"log_{c}": F.log1p(c) for c in ("min_occurrences", "total_occurrences")})


def exposure_correlations(exposed: DataFrame, scores: DataFrame) -> DataFrame:
    """count, n, r: Pearson of log1p of either count with score, of exposure() and scores(id, score)."""
    both = exposed.join(scores.select("id", "score"), "id")
    out = None
    for c in ("min_occurrences", "total_occurrences"):
        got = pearson(both, f"log_{c}", "score").withColumn("count", F.lit(c))
        out = got if out is None else out.unionByName(got)
    return out.select("count", "n", "r")


def exposure_buckets(exposed: DataFrame, scores: DataFrame) -> DataFrame:
    """bucket, items, base_mean, tuned_mean, delta of exposure() and scores(id, base, tuned)."""
    both = exposed.join(scores, "id").withColumn("bucket", exposure_bucket(F.col("min_occurrences")))
    return both.groupBy("bucket").agg(F.count("*").alias("items"), F.avg("base").alias("base_mean"), F.avg("tuned").alias("tuned_mean"), F.avg(F.col("tuned") - F.col("base")).alias("delta"))


def exposure_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").otherwise("20+")


def weighted_loss(batches: DataFrame, *by: str) -> DataFrame:
    """Token-weighted mean loss and its perplexity, of batches(loss, tokens)."""
    out = batches.groupBy(*by).agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("loss"))
    return out.withColumn("perplexity", F.exp(F.least("loss", F.lit(20.0))))


def throughput(steps: DataFrame, warm_up: int, *by: str) -> DataFrame:
    """Tokens a second after the first warm_up steps, of steps(step, tokens, seconds)."""
    kept = steps.where(F.col("step") >= warm_up)
    return kept.groupBy(*by).agg(F.try_divide(F.sum("tokens"), F.sum("seconds")).alias("tokens_per_second"))


def timing(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, median and nearest-rank 95th percentile; null where there is no value."""
    out = values.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean_seconds"))
    ranks = at_ranks(values, value, by, {**halves_of(), "p95_seconds": nearest_rank_of(0.95)})
    ranks = ranks.select(*(F.col(c).alias(f"__{c}") for c in by), middle().alias("median_seconds"), "p95_seconds")
    same = F.lit(True)
    for c in by:
        same = same & out[c].eqNullSafe(F.col(f"__{c}"))
    return out.join(ranks, same, "left").drop(*(f"__{c}" for c in by))


#: What two runs must share to be compared.
SHARED = ("config_sha256", "mode", "train_sha256", "test_sha256", "optimizer_steps", "target_tokens", "parameter_count", "parameter_dtype", "compute_dtype")


def run_comparison(runs: DataFrame, a: str, b: str) -> DataFrame:
    """failed checks, and ratios and differences of run b to run a; runs has a row for each run."""
    x, y = (runs.where(F.col("run") == r).select(*(F.col(c).alias(f"{p}_{c}") for c in runs.columns)) for r, p in ((a, "x"), (b, "y")))
    both = x.join(y)
    failed = F.array_compact(F.array(*(F.when(~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")), c) for c in SHARED if c in runs.columns)))
    ratio = lambda c: F.try_divide(f"y_{c}", f"x_{c}").alias(f"{c}_ratio")
    return both.select(failed.alias("failed_checks"), ratio("tokens_per_second"), ratio("training_seconds"), (F.col("y_loss") - F.col("x_loss")).alias("loss_difference"))
