"""Exact ranked lexical search: MaxScore over the postings of each shard.

Terms are runs of ASCII digits, letters and all that isn't ASCII, A-Z lower-cased; they are told apart by 64-bit hashes. Queries are
dealt into blocks of about QUERY_BYTES of text. For a block one scan of the documents cuts them into shards of about SHARD
bytes of text and stores a row for each shard: its documents' ids and lengths, and for every term of the block's queries its
postings (document, occurrences) there. Counts of documents, of terms and of documents by term are sums over those rows.

A second pass searches each shard. A term's upper bound there is its greatest impact in the shard. For each query
terms are ordered by their bounds; those whose bounds sum to less than the k-th score so far are non-essential. Essential
postings are added up; non-essential ones, the greatest bound first, are only probed for documents whose score and
remaining bounds still reach the k-th score. That threshold starts at the k-th score within a few shards, is carried
from shard to shard in a task, and only rises. Every task returns k rows a query at most; the best k remain,
first by parts of the documents, then of all.

All scores are whole numbers. A document's length counts in 1/100 of the mean: m = 100 - 50 + (50 n N) div L; a term of weight
w adds w ((10^9 tf) div (1000 tf + 20 m)).

Cases: null texts have no terms. Documents without an id count in all statistics and aren't ranked; queries without one are
left out, and texts of one id are one query. Repeated documents are ranked each by itself. Ties go to the
smaller id. A query without terms, or whose terms no document has, gives no rows; fewer than k documents give all with a
score above 0. Empty tables give no rows. Texts are read whole. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm import words
from loomfield.plans.shared import materialize, ship

#: Bytes of text in a shard, and of queries in a block; a longer text is one by itself.
SHARD, QUERY_BYTES = 8 << 20, 8 << 20
#: Shards that set the first thresholds; any documents' scores are a valid floor.
FLOOR_SHARDS = 4
#: Parts of the documents among which a query's best are sought before the best of all.
PARTS = 64
NONE = np.iinfo(np.int64).max

STORED = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<int>, df array<long>, ends array<long>, docs array<int>, tf array<long>"


def terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the terms in turn, index of each text's first, and one more)."""
    buf = words.LOWER[raw]
    starts, ends, first = words.spans(buf, at, words.BETWEEN)
    return words.word_hashes(buf, starts, ends), first


@dataclass
class Queries:
    """A block of queries: query i has the terms slots[ptr[i]:ptr[i+1]], places in the sorted hashes of all the block's terms."""

    ids: np.ndarray
    hashes: np.ndarray
    slots: np.ndarray
    ptr: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    n_docs: int = 0
    n_terms: int = 0
    floor: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, ids: np.ndarray, texts: pa.Array) -> Queries:
        own = {}
        for i, raw, at in words.chunks(texts):
            h, first = terms(raw, at)
            for j in range(len(at) - 1):
                own.setdefault(int(ids[i + j]), []).append(h[first[j] : first[j + 1]])
        sets = [np.unique(np.concatenate(own[i])) for i in sorted(own)]
        hashes = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        slots = np.searchsorted(hashes, np.concatenate(sets)) if sets else np.empty(0, np.int64)
        return cls(np.array(sorted(own), np.int64), hashes, slots, ptr)


def postings(raw: np.ndarray, at: np.ndarray, named: np.ndarray, hashes: np.ndarray) -> dict[str, list | np.ndarray | int]:
    """A shard's row but its ids: documents that aren't named count, and have no postings."""
    h, first = terms(raw, at)
    n, doc = np.diff(first), np.repeat(np.arange(len(at) - 1), np.diff(first))
    slot = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
    hit = hashes[slot] == h if len(hashes) else np.zeros(len(h), bool)
    key, tf = np.unique(slot[hit].astype(np.int64) * len(n) + doc[hit], return_counts=True)
    term, doc = key // max(1, len(n)), key % max(1, len(n))
    own, df = np.unique(term, return_counts=True)
    some = named[doc]
    docs, place = np.unique(doc[some], return_inverse=True)
    ends = np.searchsorted(term[some], own, "right")
    return {"n_docs": int((n > 0).sum()), "n_terms": int(n.sum()), "docs_of": docs, "sizes": n[docs], "terms": own, "df": df, "ends": ends, "docs": place, "tf": tf[some]}


def _indexed(sent):
    @words.thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        for batch in batches:
            ids = batch.column(0)
            named, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for i, raw, at in words.chunks(batch.column(1), SHARD):
                p = postings(raw, at, named[i : i + len(at) - 1], hashes)
                one = [p["n_docs"], p["n_terms"], ids[i + p["docs_of"]], p["sizes"], p["terms"].astype(np.int32), p["df"], p["ends"], p["docs"].astype(np.int32), p["tf"]]
                kinds = [pa.int64(), pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, kinds)], names=[c.split()[0] for c in STORED.split(", ")])

    return run


def lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of so many terms."""
    if len(sizes) and int(sizes.max()) * 50 * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(n) * n_docs // n_terms for n in sizes], np.int64)
    return 50 + 50 * sizes * n_docs // max(1, n_terms)


def best_of(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores with their ids, the smaller id first among equals."""
    if len(s) > 4 * k:
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, i = s[near], i[near]
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def search(q: Queries, shard: dict[str, np.ndarray], k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Merges a shard's best into best (scores and ids by query); returns the number of postings that were read or probed."""
    n = len(shard["ids"])
    impact = 10**9 * shard["tf"] // (1000 * shard["tf"] + 20 * lengths(shard["sizes"], q.n_docs, q.n_terms)[shard["docs"]])
    begins = np.concatenate([[0], shard["ends"][:-1]]).astype(np.int64)
    size = shard["ends"] - begins
    part = np.repeat(q.weight[shard["terms"]], size) * impact
    bound = np.zeros(len(size), np.int64)
    if len(part):
        bound[size > 0] = np.maximum.reduceat(part, begins[size > 0])
    at = np.full(len(q.hashes), -1)
    at[shard["terms"]] = np.arange(len(size))
    at[shard["terms"][size == 0]] = -1
    score, seen, done = np.zeros(n, np.int64), np.zeros(n, bool), 0
    for j in range(len(q.ids)):
        own = at[q.slots[q.ptr[j] : q.ptr[j + 1]]]
        own = own[own >= 0]
        own = own[np.argsort(bound[own], kind="stable")]
        upto = np.cumsum(bound[own])
        have_s, have_i = best[j]
        least = max(1, int(q.floor[j]), int(have_s[k - 1]) if len(have_s) == k else 0)
        optional = int(np.searchsorted(upto, least, "left"))  # the bounds of so many terms sum to less than the threshold
        if optional == len(own):
            continue
        score[:], seen[:] = 0, False
        for t in own[optional:].tolist():
            rows = slice(begins[t], begins[t] + size[t])
            score[shard["docs"][rows]] += part[rows]
            seen[shard["docs"][rows]] = True
            done += int(size[t])
        live = np.flatnonzero(seen)
        for x in range(optional - 1, -1, -1):
            live = live[score[live] + upto[x] >= least]
            if not len(live):
                break
            t = own[x]
            docs = shard["docs"][begins[t] : begins[t] + size[t]]
            place = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
            hit = docs[place] == live
            score[live[hit]] += part[begins[t] + place[hit]]
            done += len(live)
        live = live[score[live] >= least]
        if len(live):
            best[j] = best_of(np.concatenate([have_s, score[live]]), np.concatenate([have_i, shard["ids"][live]]), k)
    return done


def _searched(sent, k: int):
    @words.thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = sent.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q.ids]
        for batch in batches:
            for r in range(batch.num_rows):
                shard = {c: batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "sizes", "terms", "ends", "docs", "tf")}
                search(q, shard, k, best)
        ids = np.repeat(q.ids, [len(s) for s, _ in best])
        s, i = (np.concatenate([b[x] for b in best]) if best else np.empty(0, np.int64) for x in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(i), pa.array(s)], names=["query_id", "doc_id", "score"])

    return run


def _greatest(found: DataFrame, k: int, *by) -> DataFrame:
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, ids: np.ndarray, texts: pa.Array, k: int) -> DataFrame:
    spark = docs.sparkSession
    q = Queries.of(ids, texts)
    sent = spark.sparkContext.broadcast(q.hashes)
    shards = materialize(docs.mapInArrow(_indexed(sent), STORED), "postings")
    sent.destroy()
    total = shards.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    q.n_docs, q.n_terms = total.d or 0, total.t or 0
    df = np.zeros(len(q.hashes), np.int64)
    each = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
    counts = each.toArrow()
    df[counts.column("terms").to_numpy()] = counts.column("df").to_numpy()
    q.weight = np.array([math.floor(1000 * math.log((2 * q.n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    q.floor = np.zeros(len(q.ids), np.int64)
    lists = shards.select("ids", "sizes", "terms", "ends", "docs", "tf")

    def found(some: DataFrame) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(q)
        return some.mapInArrow(_searched(sent, k), "query_id long, doc_id long, score long"), sent

    first, sent = found(lists.limit(FLOOR_SHARDS))
    place = {int(x): n for n, x in enumerate(q.ids)}
    for r in _greatest(first, k).where(F.col("rank") == k).collect():
        q.floor[place[r.query_id]] = r.score
    sent.destroy()
    every, sent = found(lists)
    parts = _greatest(every, k, F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).drop("rank")
    out = materialize(_greatest(parts, k).select("query_id", "rank", "doc_id", "score"), "ranked")
    sent.destroy()
    return out


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, rank, doc_id, score: the k best of docs(id, text) for each of queries(id, text), ids as whole numbers of 64 bits."""
    ship(docs.sparkSession)
    docs, queries = (d.select(F.col(d.columns[0]).cast("long").alias("id"), F.col(d.columns[1]).cast("string").alias("text")) for d in (docs, queries))
    queries = queries.where("id is not null and text is not null")
    parts = 1 + (queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES
    out = None
    for part in range(parts):  # a query set against all rows, in blocks of bounded size
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        got = _block(docs, mine.column("id").to_numpy(), mine.column("text"), k)
        out = got if out is None else out.unionByName(got)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked(docs, items, 50).withColumnRenamed("query_id", "item_id")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS size FROM p GROUP BY 1),
a AS (SELECT count(*) AS docs, coalesce(sum(size), 0)::BIGINT AS total FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * docs) // total))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
