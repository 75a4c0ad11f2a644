"""Near-duplicate detection: fast similarity sketching, banding, and verification on full shingle sets.

A document's set is its distinct 5-word shingles (A-Z lower-cased). Documents with the same set are one class,
so copies are never compared. A class is sketched in rounds: in each of the first T rounds every shingle is
hashed to a bin and a value, and round T + i sends all shingles to bin i, so that every coordinate fills; a
bin keeps the least value of the earliest round. Coordinates of two sets agree with the probability of their
Jaccard similarity, with concentration like that of T independent samples. BANDS bands of ROWS coordinates
make buckets: at a similarity of 0.75 two classes share none with probability (1 - 0.75**5)**51, about 1e-6.

Links are found by stars: the classes of a bucket are held against its least class, and links of verified pairs
join components. Pairs whose packed sketches agree far below the threshold (over six standard deviations) are ruled
out by them; the others are confirmed on full sets. So that no link is lost to the choice of the star's centre, the
classes left in a bucket whose components differ are then held against each other in blocks of bounded numbers and
bytes, and only with blocks of such sizes of sets as can be linked, by bitmaps of their sets: a bit that only one set has stands for an element that only it has, which bounds the similarity from
above, so what the bitmaps rule out has no link. Only pairs within the bound leave a block, and are confirmed on
full sets too. Pairs within one component decide nothing.

Cases: null and empty texts, and texts of white space, have the empty set and are linked with nothing. A text
of one to four words has one shingle. Rows with the same document id count as linked with each other if they
have words, but not in keep_one(), where each of their texts stands or goes by itself. A class is named by a digest
of its set, and a component by its least document id, or null if it has none. Repeated rows are kept or go together. An empty table gives no rows. Other columns aren't read. A single text is held in memory at about
100 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm import words
from loomfield.llm.naming import unused
from loomfield.plans.components import connected
from loomfield.plans.shared import broadcast_if_small, materialize, ship

WORDS, PERCENT = 5, 75
T, ROWS, BANDS = 256, 5, 51
U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Sketches that agree in fewer of the T coordinates rule a pair out: 0.75 less six standard deviations of T samples.
LEAST_AGREE = int(T * (0.75 - 6 * (0.75 * 0.25 / T) ** 0.5))
MOST_IDS = 2_000_000
#: Classes of a block, and elements of their sets, on average at most; bits of a set's bitmap for each element; words compared at once.
BLOCK, ELEMENTS, BITS, STRIP = 1024, 4 << 20, 16, 1 << 21
_ROUND = words.mix(np.arange(1, 2 * T + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_BAND = words.mix(np.arange(1, BANDS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def sketch(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """T coordinates for each set h[ptr[i]:ptr[i+1]]; an empty set's are all EMPTY."""
    n = len(ptr) - 1
    out = np.full((n, T), EMPTY, U)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(ptr))
    open_ = np.diff(ptr) > 0
    for i in range(2 * T):
        if not len(h):
            break
        x = words.mix(h ^ _ROUND[i])
        bins = (x & U(T - 1)).astype(np.int64) if i < T else i - T
        np.minimum.at(flat, owner * T + bins, (U(i) << U(48)) | (x >> U(16)))
        at = np.flatnonzero(open_)
        filled = at[(out[at] != EMPTY).all(axis=1)]
        if len(filled):
            open_[filled] = False
            keep = open_[owner]
            h, owner = h[keep], owner[keep]
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """The bucket of each band, as 64 bits that hold the band's number too."""
    rows = s[:, : BANDS * ROWS].reshape(len(s), BANDS, ROWS)
    x = np.tile(_BAND, (len(s), 1))
    for j in range(ROWS):
        x = words.mix(x ^ rows[:, :, j]) * U(0x9E3779B97F4A7C15)
    return x


def _digests(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    return words.sums(words.mix(h ^ U(0x5851F42D4C957F2D)), ptr).view(np.int64), words.sums(words.mix(h * U(3) ^ U(0x14057B7EF767814F)), ptr).view(np.int64)


@words.thrifty
def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, buf, at in words.chunks(batch.column(1)):
            h, ptr = words.shingle_sets(buf, at, WORDS)
            d1, d2 = _digests(h, ptr)
            s = sketch(h, ptr)
            n = len(ptr) - 1
            low = words.mix(s).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), *(c.slice(i, n) for c in batch.columns[2:]), pa.array(np.diff(ptr)), pa.array(d1), pa.array(d2),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands(s).view(np.int64).reshape(-1))),
                 pa.array([r.tobytes() for r in low], pa.binary())],
                names=["doc_id", *batch.schema.names[2:], "n", "d1", "d2", "bands", "low"],
            )


@words.thrifty
def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, at in words.chunks(batch.column(0)):
            h, ptr = words.shingle_sets(buf, at, WORDS)
            d1, d2 = _digests(h, ptr)
            lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), lists], names=["d1", "d2", "set"])


@words.thrifty
def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough to be held against each other in full."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, T) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= LEAST_AGREE))


@words.thrifty
def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of a power of two of bits: a larger one folds onto a smaller one half by half."""
    for batch in batches:
        for _, buf, at in words.chunks(batch.column(0)):
            h, ptr = words.shingle_sets(buf, at, WORDS)
            d1, d2 = _digests(h, ptr)
            places = words.mix(h)
            bits = []
            for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
                size = max(64, 1 << (BITS * (b - a) - 1).bit_length()) if b > a else 64
                there = np.zeros(size, bool)
                there[(places[a:b] & U(size - 1)).astype(np.int64)] = True
                bits.append(np.packbits(there).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(np.diff(ptr)), pa.array(bits, pa.binary())], names=["d1", "d2", "n", "bits"])


def _near(n: np.ndarray, bits: list[bytes], component: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that may be linked by their bitmaps. side: 0 and 1 for the two blocks held against each other, 2 if they are one."""
    size = np.array([len(x) for x in bits])
    left, right = [], []
    for width in np.unique(size).tolist():
        x = np.flatnonzero(size == width)
        y = np.flatnonzero((size == width) | (size == 2 * width))  # sets that are linked differ in size by a third at most
        wx = np.frombuffer(b"".join(bits[i] for i in x), U).reshape(len(x), -1)
        folded = [bits[i] if size[i] == width else (np.frombuffer(bits[i][:width], U) | np.frombuffer(bits[i][width:], U)).tobytes() for i in y]
        wy = np.frombuffer(b"".join(folded), U).reshape(len(y), -1)
        ox, oy = (n[i] - np.bitwise_count(w).sum(axis=1, dtype=np.int64) for i, w in ((x, wx), (y, wy)))
        step = max(1, STRIP // max(1, wx.shape[1] * len(y)))
        for k in range(0, len(x), step):
            i, j = np.meshgrid(np.arange(k, min(k + step, len(x))), np.arange(len(y)), indexing="ij")
            i, j = i.ravel(), j.ravel()
            a, b = x[i], y[j]
            ok = (component[a] != component[b]) & ((size[b] != width) | (a < b)) & ((side[a] != side[b]) | (side[a] == 2))
            ok &= (4 * n[a] >= 3 * n[b]) & (4 * n[b] >= 3 * n[a])
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            for m in range(0, len(a), max(1, STRIP // wx.shape[1])):
                c = slice(m, m + max(1, STRIP // wx.shape[1]))
                both = np.bitwise_count(wx[i[c]] & wy[j[c]]).sum(axis=1, dtype=np.int64)
                most = np.minimum(ox[i[c]], oy[j[c]]) + both
                good = 100 * most >= PERCENT * (n[a[c]] + n[b[c]] - most)
                left.append(a[c][good])
                right.append(b[c][good])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


@words.thrifty
def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, lo, hi): the pairs of each run that may be linked."""
    waits: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        key = np.stack([rows.column(c).to_numpy() for c in ("bucket", "lo", "hi")])
        edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
        cid, component, n = (rows.column(c).to_numpy() for c in ("cid", "component", "n"))
        block, bits = rows.column("block").to_numpy(), rows.column("bits")
        found = set()
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s > 1 and (component[s:e] != component[s]).any():
                side = np.where(key[1, s:e] == key[2, s:e], 2, (block[s:e] == key[2, s:e]).astype(int))
                a, b = _near(n[s:e], bits[s:e].to_pylist(), component[s:e], side)
                found.update(zip(np.minimum(cid[s:e][a], cid[s:e][b]).tolist(), np.maximum(cid[s:e][a], cid[s:e][b]).tolist()))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(c))[batch.num_rows - 1].as_py() for c in ("bucket", "lo", "hi")]
        same = np.ones(batch.num_rows, bool)
        for c, v in zip(("bucket", "lo", "hi"), last):
            same &= batch.column(batch.schema.get_field_index(c)).to_numpy() == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            waits.append(batch.slice(0, cut))
            yield from pairs(pa.Table.from_batches(waits))
            waits = []
        elif waits and [waits[0].column(waits[0].schema.get_field_index(c))[0].as_py() for c in ("bucket", "lo", "hi")] != last:
            yield from pairs(pa.Table.from_batches(waits))
            waits = []
        waits.append(batch.slice(cut))
    if waits:
        yield from pairs(pa.Table.from_batches(waits))


def _texts(needed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that hold those of the classes needed, needed as the side of a join by digests)."""
    small = broadcast_if_small(needed, MOST_IDS)
    texts = docs.join(small.select("least_id"), docs["doc_id"] == F.col("least_id"), "left_semi")
    if needed.where("least_id is null").limit(1).count():
        texts = texts.unionByName(docs.where("doc_id is null"))
    return texts.select("text"), small


def _rest(apart: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): pairs within the bitmaps' bound among apart(bucket, cid, component)."""
    ids = apart.select("cid").distinct()
    of = materialize(classes.join(ids, "cid").select("cid", "d1", "d2", "least_id", F.col("size").alias("n")), "near-needed")
    texts, needed = _texts(of.drop("n"), docs)
    maps = texts.mapInArrow(_bitmaps, "d1 long, d2 long, n long, bits binary").join(needed, ["d1", "d2"]).dropDuplicates(["cid"]).select("cid", "n", "bits")
    maps = materialize(maps, "near-bitmaps")
    # Sets that are linked differ in size by a third at most, so they are in the same band of sizes or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / PERCENT)) * (1 + 1e-9))).cast("long")
    banded = apart.join(of.select("cid", "n"), "cid").withColumn("band", band)
    most = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).cast("long")
    sizes = banded.groupBy("bucket", "band").agg(most.alias("own"))
    by = Window.partitionBy("bucket").orderBy("band")
    sizes = sizes.withColumns({"lower": F.max("own").over(by.rangeBetween(-1, -1)), "upper": F.max("own").over(by.rangeBetween(1, 1))})
    rows = banded.join(sizes, ["bucket", "band"]).withColumn("block", F.shiftleft("band", 32) + F.pmod(F.xxhash64("cid"), "own"))
    others = [F.when(F.col(n).isNull(), F.array().cast("array<long>")).otherwise(F.sequence(F.shiftleft(F.col("band") + d, 32), F.shiftleft(F.col("band") + d, 32) + F.col(n) - 1)) for n, d in (("lower", -1), ("own", 0), ("upper", 1))]
    rows = rows.withColumn("other", F.explode(F.concat(*others)))
    rows = rows.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid", "component").join(maps, "cid")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "cid")
    return dealt.mapInArrow(_blocks, "a long, b long").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    low = classes.select("cid", "low")
    x = pairs.join(low.select(F.col("cid").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("cid").alias("b"), F.col("low").alias("y")), "b")
    likely = materialize(x.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long"), "near-likely")
    ids = likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct()
    needed = materialize(classes.join(ids, "cid").select("cid", "d1", "d2", "least_id"), "near-needed")
    texts, small = _texts(needed, docs)
    sets = texts.mapInArrow(_sets, "d1 long, d2 long, set array<long>")
    sets = materialize(sets.join(small, ["d1", "d2"]).dropDuplicates(["cid"]).select("cid", "set"), "near-sets")
    both = likely.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
    inter = F.size(F.array_intersect("x", "y"))
    return both.where(inter * 100 >= PERCENT * (F.size("x") + F.size("y") - inter)).select("a", "b")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    return _judged(docs, True)


def _judged(docs: DataFrame, by_id: bool, **carried: Column) -> DataFrame:
    """components() with more columns of type long, named by carried, after the id. by_id: whether rows with the same id count as linked."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c.alias(k) for k, c in carried.items()))
    docs = given.select("doc_id", "text")
    own = "".join(f"{k} long, " for k in carried)
    rows = materialize(given.mapInArrow(_sketched, f"doc_id long, {own}n long, d1 long, d2 long, bands array<long>, low binary"), "near-rows")
    worded = rows.where("n > 0")
    classes = materialize(worded.groupBy("d1", "d2").agg(F.first("d1").alias("cid"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("n").alias("size")), "near-classes")

    members = classes.select("cid", F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("cid").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(members.join(stars, "bucket"), "near-buckets")
    pairs = shared.where("least < cid").select(F.col("least").alias("a"), F.col("cid").alias("b")).distinct()
    links = _verified(pairs, classes, docs)
    if by_id:
        first = worded.groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("z")).where("doc_id is not null and a < z").drop("z")
        links = links.union(worded.select("doc_id", F.col("d1").alias("b")).join(first, "doc_id").where("a < b").select("a", "b"))
    links = materialize(links, "near-links")
    of = connected(links)

    labelled = shared.join(of.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    apart = materialize(labelled.join(mixed, "bucket").where("cid > least").select("bucket", "cid", "component"), "near-apart")
    rest = materialize(_rest(apart, classes, docs), "near-rest")
    more = materialize(_verified(rest, classes, docs), "near-links")
    if not more.isEmpty():
        of = connected(links.union(more))

    of = of.select(F.col("node").alias("cid"), "component")
    ids = materialize(classes.select("cid", "least_id").join(of, "cid").groupBy("component").agg(F.min("least_id").alias("id")), "near-ids")
    of = of.join(broadcast_if_small(ids, MOST_IDS), "component").select("cid", F.lit(True).alias("linked"), "id")
    named = classes.select("d1", "d2", "cid", "least_id").join(of, "cid", "left")
    named = named.select("d1", "d2", F.when(F.col("linked"), F.col("id")).otherwise(F.col("least_id")).alias("component"))
    out = rows.select("doc_id", *carried, "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", *carried, F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component another document stands for.

    What is decided for a row depends on its id and text alone, so these, the text as 128 bits, tell which rows go,
    also where rows share an id or have none.
    """
    text = docs["text"].cast("string")
    gone_id, t1, t2 = unused(docs, "gone", "t1", "t2")
    same = {t1: F.xxhash64(text), t2: F.xxhash64(F.lit("near"), text)}
    gone = materialize(_judged(docs, False, **same).where("not kept").select(F.col("doc_id").alias(gone_id), *same).distinct(), "near-gone")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id))
    for k, c in same.items():
        on &= c == F.col(k)
    return docs.join(broadcast_if_small(gone, MOST_IDS), on, "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The result by plain comparison: for small tables.
OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE
        list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(list_transform(s, lambda x: md5_number(x))) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON sym.a = r.seen)
      SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN r USING (doc_id)
"""
