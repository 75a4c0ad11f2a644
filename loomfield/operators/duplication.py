"""Duplication within groups of documents: repeated lines, shingles and near-duplicate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.urls import strip
from loomfield.plans.shared import materialize, spread


def lines(docs: DataFrame, group: str) -> DataFrame:
    """group, line, length and number of each distinct stripped line that isn't empty."""
    each = docs.select(group, F.explode(F.split("text", "\n")).alias("line")).select(group, strip(F.col("line")).alias("line")).where("line <> ''")
    return each.groupBy(group, "line").agg(F.count("*").alias("n")).withColumn("length", F.length("line"))


def line_metrics(docs: DataFrame, group: str, often: int = 5, solid: int = 20) -> DataFrame:
    """Shares of repeated lines, of distinct substantive lines and of their duplicate characters, in per cent."""
    long = F.col("length") >= solid
    when = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    out = lines(docs, group).groupBy(group).agg(
        F.sum("n").alias("lines"), when(F.col("n") >= often, F.col("n")).alias("repeated"), when(long, F.col("n")).alias("solid"), when(long, F.lit(1)).alias("solid_distinct"),
        when(long, F.col("length") * F.col("n")).alias("solid_chars"), when(long, F.col("length") * (F.col("n") - 1)).alias("duplicate_chars"),
    )
    share = lambda a, b, name: F.try_divide(F.col(a).cast("double") * 100, F.col(b)).alias(name)
    return out.select(group, share("repeated", "lines", "repeated_percent"), share("solid_distinct", "solid", "solid_unique_percent"), share("duplicate_chars", "solid_chars", "duplicate_char_percent"))


def shingle_strings(text: Column, k: int = 8) -> Column:
    """Distinct windows of k words; a shorter text has one, of all its words."""
    w = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))

    def windows(x):  # x: the words, bound once so that no window finds them again
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - k, F.lit(0))), lambda i: F.array_join(F.slice(x, i + 1, k), " ")))

    return F.element_at(F.transform(F.array(w), windows), 1)


def shingle_table(docs: DataFrame, group: str, key: str, k: int = 8) -> DataFrame:
    """group, key, n (distinct shingles of the document), shingle hash, stored: later steps read it more than once."""
    sized = lambda x: F.transform(x, lambda s: F.struct(F.size(x).cast("long").alias("n"), F.xxhash64(s).alias("shingle")))
    each = spread(docs.select(group, key, "text")).select(group, key, F.explode(F.element_at(F.transform(F.array(shingle_strings(F.col("text"), k)), sized), 1)).alias("x"))
    return materialize(each.select(group, key, "x.n", "x.shingle"), "shingles")


#: A shingle's places in prefixes are dealt over tasks by so many at most.
HOT = 1_000


def shingle_sets(shingles: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, n, single, o, stored, of documents that share shingles with others: how many of a document's shingles no other one of the group has, and the others, rare ones first."""
    counted = shingles.groupBy(group, "shingle").agg(F.count("*").alias("m")).where("m > 1")
    o = F.array_sort(F.collect_list(F.struct("m", "shingle")))
    sets = shingles.join(counted, [group, "shingle"]).groupBy(group, key, "n").agg(o.alias("o"))
    return materialize(sets.select(group, key, "n", (F.col("n") - F.size("o")).alias("single"), "o"), "shingle-sets")


def classes(sets: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, rep, stored: the least document with the same set, of documents with more than singles. Sets are compared by 128 bits of hashes."""
    h = {"h": F.xxhash64(F.col("o.shingle")), "i": F.xxhash64(F.lit(1), F.col("o.shingle"))}
    shared = sets.where("single = 0").select(group, key, "n", *(c.alias(x) for x, c in h.items()))
    reps = shared.groupBy(group, "n", "h", "i").agg(F.min(key).alias("rep"))
    alone = sets.where("single > 0").select(group, key, F.col(key).alias("rep"))
    return materialize(shared.join(reps, [group, "n", "h", "i"]).select(group, key, "rep").unionByName(alone), "shingle-classes")


def near_pairs(shingles: DataFrame, group: str, key: str, similarity: float = 0.3, containment: float = 0.6) -> DataFrame:
    """group, a, b, shared, union_size, least of pairs of documents of a group that are alike or one within the other.

    A pair qualifies if it shares `similarity` of its union or `containment` of its smaller set, so at least
    needed(smaller, larger) shingles. In one order of a group's shingles, the rare ones first, the smaller set of size m must then
    share one of its first m - needed(m, m) + 1; only those are joined with all shingles of larger sets. If the first shared
    shingle has i and j others before it, no more than the rest of either set is shared, which rules out most of what is joined. A
    shingle that is in many sets comes late in the order, so few sets have it in that prefix; the places of one that still is
    in many prefixes are dealt over tasks. Documents with the same set are one until the end, and their pairs aren't compared.

    Cases: keys are unique in a group; documents without shingles have no pairs; a null group has none.
    """
    share = similarity / (1 + similarity)
    # shared >= similarity * union is shared >= share * (a + b); the small term keeps rounding from ruling a pair out
    needed = lambda small, large: F.greatest(F.lit(1), F.ceil(F.least(containment * small, share * (small + large)) - 1e-6))
    sets = shingle_sets(shingles.where(F.col(group).isNotNull()), group, key)
    members = classes(sets, group, key)
    reps = sets.join(members.where(F.col(key) == F.col("rep")).select(group, key), [group, key])

    prefix = (F.col("n") - needed(F.col("n"), F.col("n")) + 1 - F.col("single")).cast("int")
    at = lambda name, c, i: [group, F.col(key).alias(name), F.col("n").alias(f"n_{name}"), F.col("single").alias("s"), F.posexplode(c).alias(i, "e")]
    x = reps.where(prefix > 0).select(*at("x", F.slice("o", F.lit(1), F.greatest(prefix, F.lit(0))), "i"))
    x = x.select(group, "x", "n_x", (F.col("i") + F.col("s")).alias("i"), F.col("e.m").alias("m"), F.col("e.shingle").alias("shingle"))
    parts = F.ceil(F.col("m") / HOT).cast("int")
    x = x.withColumn("part", F.pmod(F.xxhash64("x"), parts))
    y = reps.select(*at("y", F.col("o"), "j"))
    y = y.select(group, "y", "n_y", (F.col("j") + F.col("s")).alias("j"), F.col("e.shingle").alias("shingle"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("e.m") / HOT).cast("int") - 1)).alias("part"))
    larger = (F.col("n_y") > F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("y") > F.col("x")))
    enough = F.least(F.col("n_x") - F.col("i"), F.col("n_y") - F.col("j")) >= needed(F.col("n_x"), F.col("n_y"))
    candidates = x.drop("m").join(y, [group, "shingle", "part"]).where(larger & enough).select(group, "x", "y").distinct()

    side = lambda name: reps.select(group, F.col(key).alias(name), F.col("n").alias(f"n_{name}"), F.col("o.shingle").alias(f"o_{name}"))
    pairs = candidates.join(side("x"), [group, "x"]).join(side("y"), [group, "y"])
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("o_x", "o_y")).cast("long"))
    pairs = pairs.withColumns({"union_size": F.col("n_x") + F.col("n_y") - F.col("shared"), "least": F.least("n_x", "n_y")})
    alike = (F.col("shared") / F.col("union_size") >= similarity) | (F.col("shared") / F.col("least") >= containment)
    found = pairs.where(alike).select(group, "x", "y", "shared", "union_size", "least")

    member = lambda rep, name: members.select(group, F.col("rep").alias(rep), F.col(key).alias(name))
    across = found.join(member("x", "p"), [group, "x"]).join(member("y", "q"), [group, "y"]).select(group, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared", "union_size", "least")
    size = sets.select(group, F.col(key).alias("x"), F.col("n").alias("shared"))
    within = member("x", "a").join(member("x", "b"), [group, "x"]).where("a < b").join(size, [group, "x"])
    return across.unionByName(within.select(group, "a", "b", "shared", F.col("shared").alias("union_size"), F.col("shared").alias("least")))


def unique_percent(shingles: DataFrame, group: str) -> DataFrame:
    distinct = shingles.groupBy(group, "shingle").agg(F.count("*").alias("n"))
    return distinct.groupBy(group).agg((F.count("*").cast("double") * 100 / F.sum("n")).alias("unique_shingle_percent"))
