"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its own pieces best-fit decreasing. Bins that are nearly full are final; the others go
up a tree as items of their own, each with the list of its pieces: a level deals all underfull bins by a hash to
nodes, one for FAN nodes below, and each packs its share best-fit again. A node takes about NODE bins: where more
are left than one node takes, as many nodes go on side by side, so no task grows with the corpus and no bin is set
aside before its turn. The last level has one node, or as many as the level below where bins no longer get fewer: each
of those holds NODE bins dealt at random, none of which fits another.

Cases: a null text is the empty text, which is one piece: the end id alone. Repeated rows and equal or null
document ids are packed row by row. A text longer than the capacity is cut into pieces, whatever its length.
An empty table gives no rows. Other columns of the input aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm import tokens, words
from loomfield.plans.shared import materialize, ship

END = 1
#: A bin with this part of its tokens free at most is final.
NEARLY = 1 / 256
FAN, NODE = 8, 50_000
PIECE = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of sizes by bin: largest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    there = 0  # bit r: a bin with r free places exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        fits = there >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                there &= ~(1 << room)
            bins[k].append(i)
            room -= need
        else:
            k = len(bins)
            bins.append([i])
            room = capacity - need
        free.setdefault(room, []).append(k)
        there |= 1 << room
    return bins


def _bins(node: int, level: int, used: np.ndarray, blobs: list[bytes], capacity: int, last: bool) -> pa.RecordBatch:
    """One row per bin: final bins, or ones for the level above."""
    packed = best_fit(used, capacity)
    full = np.array([int(used[b].sum()) for b in packed], np.int64)
    done = full >= (0 if last else capacity * (1 - NEARLY))
    ids = (level << 56) + (node << 24) + np.arange(len(packed), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(done), pa.array(full), pa.array([b"".join(blobs[i] for i in b) for b in packed], pa.binary())], names=["bin", "done", "used", "pieces"])


_BINS = "bin long, done boolean, used long, pieces binary"


def _local(path: str, capacity: int):
    @words.thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokens.encode(text.as_py(), path), np.uint16(END)).astype("<u4")
                rows = np.zeros(-(-len(ids) // capacity), PIECE)
                rows["doc_id"], rows["known"] = doc_id or 0, doc_id is not None
                rows["piece"] = np.arange(len(rows))
                rows["start"] = rows["piece"].astype(np.int64) * capacity
                rows["length"] = np.minimum(capacity, len(ids) - rows["start"])
                rows["crc"] = [zlib.crc32(ids[a : a + capacity].tobytes()) for a in rows["start"]]
                found.append(rows)
        if found:
            rows = np.concatenate(found)
            yield _bins(TaskContext.get().partitionId(), 0, rows["length"].astype(np.int64), [r.tobytes() for r in rows], capacity, False)

    return run


def _merge(level: int, capacity: int, last: bool):
    """Packs the bins of each node, which is a partition, in the order of their ids."""

    @words.thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            rows = pa.Table.from_batches(found).sort_by([("node", "ascending"), ("bin", "ascending")])
            nodes = rows.column("node").to_numpy()
            for node in np.unique(nodes).tolist():
                own = rows.slice(int(np.searchsorted(nodes, node)), int((nodes == node).sum()))
                yield _bins(node, level, own.column("used").to_numpy(), own.column("pieces").to_pylist(), capacity, last)

    return run


@words.thrifty
def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(b, PIECE) for b in batch.column(1).to_pylist()]
        if not rows:
            continue
        n = np.array([len(r) for r in rows])
        all_ = np.concatenate(rows)
        length = all_["length"].astype(np.int64)
        before = np.cumsum(length) - length
        first = np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays(
            [pa.array(all_["doc_id"], mask=all_["known"] == 0), pa.array(all_["piece"]), pa.array(all_["start"]), pa.array(length), pa.array(all_["crc"].astype(np.int64)),
             pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(before - np.repeat(before[first], n))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary or tokens.default_vocabulary()
    level, nodes = 0, None
    bins = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_local(path, capacity), _BINS), "pack-0")
    final = bins.where("done").select("bin", "pieces")
    while True:
        level += 1
        left, below = bins.where("not done").agg(F.count("*"), F.count_distinct(F.shiftright("bin", 24))).first()
        above = max(1, -(-min(below, nodes or below) // FAN), -(-left // NODE))
        last = above == 1 or nodes is not None and above >= nodes
        nodes = above
        dealt = bins.where("not done").select("bin", "used", "pieces", F.pmod(F.xxhash64("bin"), F.lit(nodes)).cast("int").alias("node"))
        bins = materialize(dealt.repartitionById(nodes, F.col("node")).mapInArrow(_merge(level, capacity, last), _BINS), f"pack-{level}")
        final = final.unionByName(bins.where("done").select("bin", "pieces"))
        if last:
            break
    return final.mapInArrow(_placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
