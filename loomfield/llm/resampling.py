"""Importance resampling of documents towards the distribution of a target's words and pairs of words.

Identical texts are grouped by their full text first, with the number of their copies. Each distinct text's features are
hashed once and stored as its sorted buckets; corpus counts multiply them by the copies. A bucket's gain is the scaled
logarithm of its share in the target over its share in the corpus, both smoothed by one. A text's weight, the floored
mean of its gains, is computed once and joined back to its documents by the text's SHA-256. Only then does every
document get noise of its own (Gumbel's, from a hash of its id), and the highest scores are drawn without replacement.

Scores are whole numbers within some 10^5 of 0, so counts by score are few whatever the size: they give the score of
the last place, and places above it are prefix sums over scores. Rows of one score are numbered in one task; the noise
spreads even documents of one weight so far that a score has at most some 4 in 10,000 of them.

Cases: a null text counts as the empty one, which has no features and weight 0. Copies of a row each have a row and a place
of their own. Documents without an id have the noise of the empty id, and come after others of their score. An empty target makes
all buckets alike in it; an empty table gives no rows. Texts are read whole. Columns of the result replace columns of
the same names, others are kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import words
from loomfield.llm.naming import unused
from loomfield.plans.prefix import prefix_in_groups
from loomfield.plans.shared import materialize, ship

BUCKETS, SEED, LEAST_WORDS = 10_000, 7, 20
#: Longer words are hashed one by one.
LONG = 64
#: Tied documents without an id are dealt over so many buckets.
SALTS = 64
ALL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    """The CRC-32 register's change by a byte, by the reversed polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


CRC = _table()


def registers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of spans, each from the register that begun has for it; all spans take a byte at a time."""
    out, size = begun.copy(), ends - starts
    rows = np.flatnonzero(size <= LONG)
    rows = rows[np.argsort((LONG - size[rows]).astype(np.uint8), kind="stable")]  # long ones first
    at, reg, left = starts[rows], out[rows], np.sort(size[rows])
    for j in range(int(left[-1]) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left, j, "right"))
        reg[:n] = CRC[(reg[:n] ^ buf[at[:n] + j]) & np.uint32(0xFF)] ^ (reg[:n] >> np.uint32(8))
    out[rows] = reg
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]], int(begun[i] ^ ALL)) ^ int(ALL)
    return out


def features(raw: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted buckets of each text's words and pairs, where each text's begin, words by text)."""
    buf = words.LOWER[raw]
    starts, ends, first = words.spans(buf, at, words.BETWEEN)
    per = np.diff(first)
    single = registers(buf, starts, ends, np.full(len(starts), ALL))
    paired = np.ones(len(starts), bool)
    paired[first[1:][per > 0] - 1] = False  # a text's last word begins no pair
    i = np.flatnonzero(paired)
    space = CRC[(single[i] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (single[i] >> np.uint32(8))
    double = registers(buf, starts[i + 1], ends[i + 1], space)
    ptr = np.concatenate([[0], np.cumsum(np.maximum(2 * per - 1, 0))])
    doc = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(starts)) - first[:-1][doc]
    out = np.empty(ptr[-1], np.uint16)
    out[ptr[doc] + nth] = (single ^ ALL) % np.uint32(buckets)
    out[ptr[doc[i]] + per[doc[i]] + nth[i]] = (double ^ ALL) % np.uint32(buckets)
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
        out[a:b].sort()
    return out, ptr, per


def _gaps(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Each text's sorted buckets as differences, 16 bits each, which compress well."""
    gaps = values.copy()
    gaps[1:] -= values[:-1]
    begin = ptr[:-1][ptr[:-1] < ptr[1:]]
    gaps[begin] = values[begin]
    return pa.Array.from_buffers(pa.binary(), len(ptr) - 1, [None, pa.py_buffer((2 * ptr).astype(np.int32)), pa.py_buffer(gaps.astype("<u2"))])


def _stored(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, where each text's begin) of a column made by _gaps."""
    col = batch.column(name)
    _, at, data = col.buffers()
    at = np.frombuffer(at, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    gaps = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u2") if data is not None else np.empty(0, "<u2")
    ptr = (at - at[0]) // 2
    total = np.concatenate([[0], np.cumsum(gaps, dtype=np.int64)])
    return total[1:] - np.repeat(total[ptr[:-1]], np.diff(ptr)), ptr


def distinct(texts: DataFrame, text: str, buckets: int) -> DataFrame:
    """(key, copies, words, buckets), stored: a row for each full text."""

    @words.thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, at in words.chunks(batch.column("text")):
                values, ptr, per = features(raw, at, buckets)
                key, copies = (batch.column(c).slice(i, len(per)) for c in ("key", "copies"))
                yield pa.RecordBatch.from_arrays([key, copies, pa.array(per.astype(np.int64)), _gaps(values, ptr)], names=["key", "copies", "words", "buckets"])

    ship(texts.sparkSession)
    grouped = texts.groupBy(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    keyed = grouped.select(digest(F.col("text")).alias("key"), "copies", "text")
    return materialize(keyed.mapInArrow(run, "key binary, copies long, words long, buckets binary"), "distinct-texts")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def counts(texts: DataFrame, buckets: int) -> list[int]:
    """How many features of all copies fall into each bucket, from distinct texts: a row for each bucket reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, ptr = _stored(batch, "buckets")
            copies = batch.column("copies").to_numpy()
            many = np.repeat(copies > 1, np.diff(ptr))
            total += np.bincount(values[~many], minlength=buckets)
            weight = np.repeat(copies, np.diff(ptr))[many]
            total += np.rint(np.bincount(values[many], weight, buckets)).astype(np.int64)  # exact below 2^53
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = [0] * buckets
    for r in texts.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) by bucket."""
    n, every, all_target = len(corpus), float(sum(corpus)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (every + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(corpus, target)], np.int64)


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, words, n_features, weight) of distinct texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ptr = _stored(batch, "buckets")
            n = np.diff(ptr)
            weight = words.sums(gain[values], ptr) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("words"), pa.array(n), pa.array(weight)], names=["key", "words", "n_features", "weight"])

    return texts.select("key", "words", "buckets").mapInArrow(run, "key binary, words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, unless named) with n_features, weight, score and rank, which only the drawn documents have.

    The highest scores of documents with least_words or more are drawn, percent of those in 100.
    """
    made = ("n_features", "weight", "score", "rank")
    texts = distinct(docs, text, buckets)
    gain = gains(counts(texts, buckets), counts(distinct(target, text, buckets), buckets))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    key, n, place, tie, own, one, before = unused(docs.select(*kept, *(F.lit(0).alias(m) for m in made)), "key", "words", "place", "tie", "own_id", "one", "before")
    each = docs.select(*kept, F.col(doc_id).alias(own), digest(F.col(text)).alias(key))
    found = each.join(weights(texts, gain).withColumnsRenamed({"key": key, "words": n}), key)
    found = found.withColumn("score", F.col("weight") + noise(F.col(own), seed))
    found = found.withColumn(tie, F.when(F.col(own).isNull(), 1 + F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(0)).drop(key)
    found = materialize(found, "scored")

    by_score = found.where(F.col(n) >= least_words).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    take = int(by_score["n"].sum()) * percent // 100
    last = int(by_score["score"].iloc[int(np.searchsorted(by_score["n"].cumsum(), take))]) if take else None
    top = F.lit(False) if last is None else (F.col(n) >= least_words) & (F.col("score") >= last)
    some = found.where(top).withColumns({place: F.struct((-F.col("score")).alias("s"), F.col(tie).alias("t")), one: F.lit(1)})
    ranked = prefix_in_groups(some, one, place, [F.col(own).asc_nulls_last()], one, before)
    ranked = ranked.withColumn("rank", F.when(F.col(before) < take, F.col(before) + 1))
    rest = found.where(~top).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*kept, *made).unionByName(rest.select(*kept, *made))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target, keep=["doc_id"])


OP12_SQL = r"""
WITH RECURSIVE crc(b, k, v) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM crc WHERE k = 8),
w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
      UNION ALL
      SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
c AS (SELECT kind, id, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM c)),
b AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda s, y: xor(s // 256, t[(xor(s, y) % 256) + 1])), 4294967295) % 10000 AS b FROM h, tab),
k AS (SELECT b, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM c JOIN b USING (f) GROUP BY b),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM k),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(k.t, 0) + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((coalesce(k.s, 0) + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM k, a),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM c JOIN b USING (f) JOIN g USING (b) WHERE kind = 'd' GROUP BY id),
s AS (SELECT w.id AS doc_id, len(w.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(total / n_features::DOUBLE) AS BIGINT), 0) AS weight,
             CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT)::DOUBLE AS h FROM w LEFT JOIN m USING (id) WHERE w.kind = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM e WHERE words >= 20) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
