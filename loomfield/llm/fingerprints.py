"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every 5-word shingle is hashed once; the high bits choose one of BINS bins and the least value of a bin stays.
An empty bin takes the value of a bin found by its own sequence of hashes, the same for all documents, so that
two sets agree in a bin with the probability of their Jaccard similarity. BITS low bits of each bin are kept, as
hexadecimal digits; the likeness of two fingerprints subtracts the agreement that chance gives.

For the query, documents are ranged by descending id and a hash of the text, RANGE bytes of text to a range, so whole
texts move once and rows stream through in order. The last document of a range, which hasn't met the next one, and
the first of each range are stored with their texts, and held against each other by the number of the range.

Cases: null, empty and blank texts have the fingerprint "", which is like itself (1) and unlike all others (0).
A text of one to four words has one shingle. Rows with equal ids follow each other by a hash of the text and the text, so ranges may
part them; null ids come last.
A single document is followed by itself. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import words
from loomfield.llm.labelled import ranges_for
from loomfield.plans.shared import materialize, ship

WORDS, BINS, BITS = 5, 512, 4
U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Draws made one by one; for bins that are empty after these, the table of all first draws decides.
DRAWS = 32
#: Rows handled at once.
ROWS = 1000


def minima(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The least value by bin for each set h[ptr[i]:ptr[i+1]]."""
    n = len(ptr) - 1
    out = np.full(n * BINS, EMPTY, U)
    owner = np.repeat(np.arange(n), np.diff(ptr))
    shift = 64 - BINS.bit_length() + 1
    np.minimum.at(out, owner * BINS + (h >> U(shift)).astype(np.int64), h & U((1 << shift) - 1))
    return out.reshape(n, BINS)


def _drawn(bins: np.ndarray, t: int) -> np.ndarray:
    """The bins that the t-th draw of empty bins asks."""
    return (words.mix((bins.astype(U) << U(16)) + U(t + 1)) & U(BINS - 1)).astype(np.int64)


@cache
def _first_draws() -> np.ndarray:
    """By empty bin and bin: the number of the draw that first asks it."""
    out, bins, t = np.full((BINS, BINS), -1, np.int32), np.arange(BINS), 0
    while (out < 0).any():
        to = _drawn(bins, t)
        out[bins, to] = np.where(out[bins, to] < 0, t, out[bins, to])
        t += 1
    return out


def densify(x: np.ndarray) -> np.ndarray:
    """x with every empty bin filled from the first full one that its draws ask, for sets that have any full one."""
    full = x != EMPTY
    out = x.copy()
    d, b = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(DRAWS):
        if not len(d):
            return out
        to = _drawn(b, t)
        hit = full[d, to]
        out[d[hit], b[hit]] = x[d[hit], to[hit]]
        d, b = d[~hit], b[~hit]
    for i in np.unique(d).tolist():
        empty, there = b[d == i], np.flatnonzero(full[i])
        out[i, empty] = x[i, there[_first_draws()[np.ix_(empty, there)].argmin(axis=1)]]
    return out


def packed(texts: pa.Array) -> np.ndarray:
    """BITS low bits by bin for each text, one byte a bin; the last column tells texts with words."""
    out = np.zeros((len(texts), BINS + 1), np.uint8)
    for i, buf, at in words.chunks(texts):
        starts, ends, first = words.spans(words.LOWER[buf], at)
        h, ptr = words.shingles(words.word_hashes(words.LOWER[buf], starts, ends), first, WORDS)
        some = np.diff(ptr) > 0
        low = (words.mix(densify(minima(h, ptr))) & U((1 << BITS) - 1)).astype(np.uint8)
        out[i : i + len(some), :BINS] = low * some[:, None]
        out[i : i + len(some), BINS] = some
    return out


def as_text(x: np.ndarray) -> list[str]:
    halves = (x[:, 0:BINS:2] << 4 | x[:, 1:BINS:2]).astype(np.uint8)
    return [r.tobytes().hex() if some else "" for r, some in zip(halves, x[:, BINS].tolist())]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of the shingle sets, row by row, from 0 to 1."""
    chance = 1 / (1 << BITS)
    agree = (x[:, :BINS] == y[:, :BINS]).mean(axis=1)
    j = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where((x[:, BINS] == 1) & (y[:, BINS] == 1), j, (x[:, BINS] == y[:, BINS]).astype(float))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def _edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _held(doc_id: list, text: list[str], after: list[str], own: np.ndarray, next_: np.ndarray) -> list[pa.Array]:
    """The columns of _OUT for texts, the texts that follow them, and the packed fingerprints of both."""
    edited = [_edited(t, a) for t, a in zip(text, after)]
    x = packed(pa.array(edited, pa.large_string()))
    return [pa.array(doc_id, pa.int64()), pa.array([len(t) for t in text], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(as_text(own), pa.string()), pa.array(as_text(x), pa.string()), pa.array(likeness(own, x)), pa.array(likeness(own, next_))]


def _with_next(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, held against the next one: edge is 0. The first (1) and the last (2) document stand by themselves, with their texts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    wait = None  # (doc_id, text, fingerprint) of the last row, whose next one hasn't come

    def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *none, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text])], names=[*_COLUMNS, "edge", "part", "text"])

    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            rows = batch.slice(k, ROWS)
            doc_id, text = (rows.column(i).to_pylist() for i in range(2))
            text = [t or "" for t in text]
            own = packed(pa.array(text, pa.large_string()))
            if wait is None:
                yield edge(1, doc_id[0], text[0])
            else:
                doc_id, text, own = [wait[0], *doc_id], [wait[1], *text], np.concatenate([wait[2][None], own])
            wait = doc_id[-1], text[-1], own[-1]
            n = len(text) - 1
            if n:
                made = _held(doc_id[:-1], text[:-1], text[1:], own[:-1], own[1:])
                yield pa.RecordBatch.from_arrays([*made, pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string())], names=[*_COLUMNS, "edge", "part", "text"])
    if wait is not None:
        yield edge(2, *wait[:2])


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for (doc_id, text, text that follows)."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            doc_id, text, after = (c.to_pylist() for c in batch.slice(k, ROWS).columns)
            own, next_ = (packed(pa.array(x, pa.large_string())) for x in (text, after))
            yield pa.RecordBatch.from_arrays(_held(doc_id, text, after, own, next_), names=_COLUMNS)


def fingerprint(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document of docs(doc_id, text), held against its edited text and the next document."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("t"))
    order = [F.desc_nulls_last("doc_id"), F.col("t")]
    placed = docs.repartitionByRange(ranges or ranges_for(docs, "text"), *order).sortWithinPartitions(*order, "text")
    found = materialize(placed.select("doc_id", "text").mapInArrow(_with_next, f"{_OUT}, edge int, part int, text string"), "fingerprints")
    parts = sorted(r.part for r in found.where("edge = 1").select("part").collect())  # a number per range
    if not parts:
        return found.select(*_COLUMNS)
    next_ = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, follows int")
    firsts = found.where("edge = 1").select(F.col("part").alias("follows"), F.col("text").alias("after"))
    lasts = found.where("edge = 2").select("doc_id", "text", "part").join(next_, "part").join(firsts, "follows").select("doc_id", "text", "after")
    return found.where("edge = 0").select(*_COLUMNS).unionByName(lasts.mapInArrow(_met, _OUT))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
