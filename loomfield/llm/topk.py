"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are terms with impacts: component i counts as two terms, one for its positive and one for its negative
values. Within a task documents are reordered into ranges of alike vectors and cut into blocks of BLOCK. A block
keeps the greatest and the least value of each component, so the sum over a query's components of the greater
product bounds every score in the block. Each query takes blocks in descending order of their bounds, scores
them through the block's forward index (its rows), and stops when a bound is below its k-th score so far. That
threshold starts at the k-th score among the query block itself where the caller says that queries are rows too,
else at minus infinity, and only rises.

Queries are dealt into blocks of about QUERY_BLOCK by a hash. Each block is sent to the tasks in turn, its results are
stored, and it is released before the next one is sent, so what is broadcast at a time doesn't grow with the data.
Every task returns k rows a query at most, and the best k of those remain.

Cases: rows without an id or a vector, or with null, NaN or infinite components, take no part. A vector shorter
than the query's counts as if it ended in zeros. Rows with the query's own id aren't candidates for it; a
query id with several vectors is answered once, each candidate row with its greatest score for any of them. Ties go to the smaller id, repeated
candidates count as often as they are there. An empty table gives no rows; fewer than k candidates give all.
Products beyond the exact range of doubles are summed as exact integers; a score that doesn't fit 64 bits is an error. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.plans.shared import materialize, ship

BLOCK, QUERY_BLOCK = 64, 16_384
#: Rows of a query block that set its first thresholds; any candidates' scores are a valid floor.
FLOOR_ROWS = 2048
EXACT = 2.0**53
#: The score of a place that no candidate has.
NONE = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """Whether a vector is there with finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


@dataclass
class Queries:
    ids: np.ndarray
    vectors: np.ndarray
    floor: np.ndarray  # a score that k candidates reach, or -inf

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, k: int, among: bool = True) -> Queries:
        """among: whether the queries are candidates too, whose scores then set the floor."""
        floor = np.full(len(ids), -np.inf)
        if not among:
            return cls(ids, vectors, floor)
        some = slice(0, FLOOR_ROWS)
        for i in range(0, len(ids), 512):  # the query block's rows are candidates of one another
            s = scores(vectors[i : i + 512], vectors[some]).astype(float)
            s[ids[i : i + 512, None] == ids[None, some]] = -np.inf
            if s.shape[1] > k:
                floor[i : i + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return cls(ids, vectors, floor)


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of width components, filled with zeros."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(size.max(initial=0)))
    if (size == width).all():
        return values.reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    out[np.arange(width)[None, :] < size[:, None]] = values
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and x."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a for a in (q, x))
    if not len(q) or not len(x) or width * max(1.0, abs(q).max()) * max(1.0, abs(x).max()) < EXACT:
        return (q @ x.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q], np.int64)


def ranges(x: np.ndarray) -> list[np.ndarray]:
    """Rows of x in blocks of alike vectors: halves along the component that varies most, again and again."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        f = int(x[rows].var(axis=0).argmax())
        order = rows[np.argsort(x[rows, f], kind="stable")]
        half = max(BLOCK, len(rows) // BLOCK // 2 * BLOCK)
        todo += [order[half:], order[:half]]
    return out


def search(queries: Queries, ids: np.ndarray, x: np.ndarray, k: int, best_s: np.ndarray, best_i: np.ndarray, rows_of: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Merges the best of x into best_s, best_i (queries by k, NONE where none); returns the number of scored pairs.

    rows_of: numbers of the rows of x, and where those of the best are kept beside best_i.
    """
    width = max(queries.vectors.shape[1], x.shape[1])
    q = np.pad(queries.vectors, ((0, 0), (0, width - queries.vectors.shape[1])))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    blocks = ranges(x)
    most = np.stack([x[b].max(axis=0) for b in blocks])
    least = np.stack([x[b].min(axis=0) for b in blocks])
    bounds = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    bounds += abs(bounds) * 1e-12  # sums of large products are rounded
    order = np.argsort(-bounds, axis=1, kind="stable")
    live, done = np.arange(len(q)), 0
    for turn in range(len(blocks)):
        kth = np.maximum(queries.floor[live], np.where(best_s[live, k - 1] == NONE, -np.inf, best_s[live, k - 1]))
        live = live[bounds[live, order[live, turn]] >= kth]
        if not len(live):
            break
        block_of = order[live, turn]
        by = np.argsort(block_of, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(block_of[by])) + 1):
            who, rows = live[part], blocks[block_of[part[0]]]
            s = scores(q[who], x[rows])
            done += s.size
            own = queries.ids[who, None] == ids[None, rows]
            s = np.where(own, NONE, s)
            all_s = np.concatenate([best_s[who], s], axis=1)
            all_i = np.concatenate([best_i[who], np.broadcast_to(ids[rows], s.shape)], axis=1)
            top = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            best_s[who] = np.take_along_axis(all_s, top, 1)
            best_i[who] = np.take_along_axis(all_i, top, 1)
            if rows_of is not None:
                nth, best_n = rows_of
                best_n[who] = np.take_along_axis(np.concatenate([best_n[who], np.broadcast_to(nth[rows], s.shape)], axis=1), top, 1)
    return done


def _task(sent, k: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = sent.value
        best_s = np.full((len(queries.ids), k), NONE)
        best_i = np.full((len(queries.ids), k), np.iinfo(np.int64).max)
        repeats = len(np.unique(queries.ids)) < len(queries.ids)
        best_n, seen = np.zeros_like(best_i) if repeats else None, 0
        for batch in batches:
            if n := batch.num_rows:
                x = matrix(batch.column(1), queries.vectors.shape[1])
                search(queries, batch.column(0).to_numpy(), x, k, best_s, best_i, (np.arange(seen, seen + n), best_n) if repeats else None)
                seen += n
        i, j = np.nonzero(best_s != NONE)
        query, vec, score = queries.ids[i], best_i[i, j], best_s[i, j]
        if repeats:  # a candidate row once for each query id, with its greatest score
            row = best_n[i, j]
            order = np.lexsort((-score, row, query))
            query, vec, score, row = query[order], vec[order], score[order], row[order]
            once = np.concatenate([[True], (np.diff(query) != 0) | (np.diff(row) != 0)]) if len(row) else np.empty(0, bool)
            query, vec, score = query[once], vec[once], score[once]
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, among: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of rows(id, vector) for each of queries(id, vector), vectors of whole numbers.

    among: whether all queries are among rows, which prunes sooner; results are wrong if it is set and they aren't.
    """
    spark = rows.sparkSession
    ship(spark)
    rows, queries = (d.select("id", "vector").where("id is not null and vector is not null") for d in (rows, queries))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for part in range(parts):  # a query set against all rows, in blocks of bounded size
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).dropDuplicates().toArrow()
        ids = mine.column("id").to_numpy()
        sent = spark.sparkContext.broadcast(Queries.of(ids, matrix(mine.column("vector"), 0) if len(ids) else np.zeros((0, 1)), k, among))
        got = rows.mapInArrow(_task(sent, k), "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        got = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        got = materialize(got, "top-k")
        sent.destroy()
        found = got if found is None else found.unionByName(got)
    return found


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where("id % 50 = 0"), 5, among=True)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
