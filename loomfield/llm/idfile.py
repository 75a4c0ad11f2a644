"""Token-id files: canonical length-limited Huffman codes in independent blocks with checkpoints.

Documents are ranged by id and a hash of the text, about equally many bytes of text to a range, and a range is
written as files of about FILE ids, so a task holds one file's ids at a time. A file holds the ids of documents in
the order of their ids:

    magic, then little-endian: 8-byte ids before this file, 4-byte lengths of the three zlib parts
    zlib part 1: code length of every id of the vocabulary, one byte each
    zlib part 2: per document 8-byte id, 1 byte whether the id is known, 4-byte number of ids
    zlib part 3: per block 4-byte number of bytes; then, for all checkpoints, 4-byte bit offset in the block
    the blocks

Codes follow from their lengths: by length, then id. Codes are counted over the whole corpus. Each block starts
on a byte and has BLOCK ids (the last fewer), and a checkpoint every STEP ids tells where to start, so decoding
reads from all checkpoints at once through one table of the next LIMIT bits.

Files go to the shared folder under a temporary name and are renamed, so a task that runs again does no harm. The
driver gathers the counts of the vocabulary; where each file's ids begin is a distributed prefix sum over files.

Cases: a null text is the empty text and has only the end id. Rows with equal or null document ids stay rows of
their own; null ids come first, equal ids by a hash of the text and the text, so ranges may part them. A text may be of any length. An empty table writes no file and
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import tokens
from loomfield.llm.labelled import MOST_RANGES, ranges_for
from loomfield.plans.prefix import prefix_in_groups
from loomfield.plans.shared import materialize, new_path, ship

MAGIC = b"LFIDS\x00\x00\x01"
END, LIMIT, BLOCK, STEP = 1, 16, 1 << 16, 256
#: A file ends after the document that brings it to so many ids.
FILE = 8 << 20
SIZE = 1 << 16
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u4")])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over limit (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.int64)
    levels, list_ = [], leaf
    isleaf = np.ones(len(leaf), bool)
    for _ in range(limit):
        levels.append(isleaf)
        even = list_[: len(list_) // 2 * 2]
        both = np.concatenate([leaf, even[0::2] + even[1::2]])
        order = np.argsort(both, kind="stable")
        list_, isleaf = both[order], order < len(leaf)
    take = 2 * len(leaf) - 2
    for isleaf in reversed(levels):
        leaves = int(isleaf[:take].sum())
        out[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of lengths."""
    out = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for i in sorted(np.flatnonzero(lengths).tolist(), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        out[i] = code
        code += 1
    return out


def _block(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ids, padded to a byte, and the offset of every STEP-th."""
    n = length[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    c = code[ids]
    word, shift = starts >> 6, 64 - (starts & 63) - n
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    high = np.where(shift >= 0, c << np.maximum(shift, 0).astype(np.uint64), c >> np.maximum(-shift, 0).astype(np.uint64))
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[at]] = np.bitwise_or.reduceat(high, at)
    over = np.flatnonzero(shift < 0)
    out[word[over] + 1] |= c[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STEP].astype("<u4")


def encode_file(docs: np.ndarray, ids: np.ndarray, lengths: np.ndarray, before: int) -> bytes:
    code = codes(lengths)
    blocks = [_block(ids[i : i + BLOCK], code, lengths) for i in range(0, len(ids), BLOCK)]
    parts = [zlib.compress(lengths.tobytes()), zlib.compress(docs.tobytes()),
             zlib.compress(np.array([len(b) for b, _ in blocks], "<u4").tobytes() + b"".join(p.tobytes() for _, p in blocks))]
    return b"".join([MAGIC, struct.pack("<q3I", before, *map(len, parts)), *parts, *(b for b, _ in blocks)])


def decode_file(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(ids before this file, its documents, its ids)."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("this is no file of token ids")
    before, *sizes = struct.unpack_from("<q3I", data, len(MAGIC))
    at = len(MAGIC) + struct.calcsize("<q3I")
    parts = []
    for n in sizes:
        parts.append(zlib.decompress(data[at : at + n]))
        at += n
    lengths, docs = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], _DOC)
    total = int(docs["n"].sum())
    blocks = -(-total // BLOCK)
    index = np.frombuffer(parts[2], "<u4").astype(np.int64)
    size, points = index[:blocks], index[blocks:]
    block_of = np.arange(len(points)) // (BLOCK // STEP)
    pos = points + (8 * (np.cumsum(size) - size))[block_of]
    code = codes(lengths).astype(np.int64)
    symbols, taken = np.zeros(1 << LIMIT, np.uint16), np.zeros(1 << LIMIT, np.int64)
    for i in np.flatnonzero(lengths).tolist():
        a, b = int(code[i]) << (LIMIT - int(lengths[i])), (int(code[i]) + 1) << (LIMIT - int(lengths[i]))
        symbols[a:b], taken[a:b] = i, lengths[i]
    bits = np.frombuffer(data, np.uint8, offset=at)
    bits = np.concatenate([bits, np.zeros(8, np.uint8)])
    window = bits[:-2].astype(np.uint32) << 16 | bits[1:-1].astype(np.uint32) << 8 | bits[2:].astype(np.uint32)
    out = np.zeros((STEP, len(points)), np.uint16)
    for k in range(STEP):
        next_ = (window[np.minimum(pos >> 3, len(window) - 1)] >> (8 - (pos & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
        out[k] = symbols[next_]
        pos = pos + taken[next_]
    return before, docs, out.T.reshape(-1)[:total]  # only the last block can be short, so what is read past its end comes last


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, data: bytes) -> None:
    store, path = _fs(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    try:
        store.move(part, f"{path}/{name}")
    except OSError:  # some stores don't move onto a file; the one there is of an earlier attempt and the same
        store.delete_file(part)
        if not store.get_file_info(f"{path}/{name}").is_file:
            raise


def _get(folder: str, name: str) -> bytes:
    store, path = _fs(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def _staged(folder: str, vocabulary: str):
    """Encodes rows in order, writes each file's ids as they are, and tells how often each id occurs and how many a file has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        counts = np.zeros(SIZE, np.int64)
        totals: list[int] = []
        docs, ids, held = [], [], 0

        def flush():
            all_ = b"".join(ids)
            for i in range(0, len(all_), 2 << 20):
                counts[:] += np.bincount(np.frombuffer(all_[i : i + (2 << 20)], "<u2"), minlength=SIZE)
            _put(folder, f"{part:06d}-{len(totals):06d}.ids", struct.pack("<2Q", len(docs), len(all_)) + np.array(docs, _DOC).tobytes() + pa.compress(all_, "zstd", asbytes=True))
            totals.append(len(all_) // 2)

        end = np.uint16(END).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = tokens.encode(text.as_py(), vocabulary).tobytes() + end
                docs.append((doc_id or 0, doc_id is not None, len(got) // 2))
                ids.append(got)
                held += len(got) // 2
                if held >= FILE:
                    flush()
                    docs, ids, held = [], [], 0
        if docs:
            flush()
        used = np.flatnonzero(counts)
        none = np.full(len(used), -1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(none), pa.array(used.astype(np.int64)), pa.array(counts[used])], names=["part", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(totals), part, np.int64)), pa.array(np.arange(len(totals), dtype=np.int64)), pa.array(totals, pa.int64())], names=["part", "key", "n"])

    return run


def _coded(stage: str, folder: str, lengths: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, key, before in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "before"))):
                data = _get(stage, f"{part:06d}-{key:06d}.ids")
                n, size = struct.unpack_from("<2Q", data)
                docs = np.frombuffer(data, _DOC, n, 16)
                ids = np.frombuffer(pa.decompress(data[16 + docs.nbytes :], size, "zstd", asbytes=True), "<u2")
                _put(folder, f"{part:06d}-{key:06d}.lfids", encode_file(docs, ids, np.frombuffer(lengths, np.uint8), before))
            yield batch.select(["part"])

    return run


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            before, docs, ids = decode_file(data.as_py())
            ends = np.cumsum(docs["n"].astype(np.int64))
            starts = ends - docs["n"]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"], mask=docs["known"] == 0), pa.array(starts + before), pa.array(docs["n"].astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, ranges: int | None = None) -> int:
    """Writes the ids of docs(doc_id, text), an end id after each document, as files in folder; returns the number of ids."""
    spark = docs.sparkSession
    ship(spark)
    stage = f"{folder}-stage"
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("t"))
    order = [F.asc_nulls_first("doc_id"), F.col("t")]
    placed = docs.repartitionByRange(ranges or ranges_for(docs, "text"), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    told = materialize(placed.mapInArrow(_staged(stage, vocabulary or tokens.default_vocabulary()), "part long, key long, n long"), "token-counts")
    counts = np.zeros(SIZE, np.int64)
    for r in told.where("part < 0").groupBy("key").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        counts[r.key] = r.n
    lengths = code_lengths(counts).tobytes()
    files = told.where("part >= 0").withColumns({"of": F.lit(0), "one": F.lit(1)})
    n, total = files.agg(F.count("*"), F.sum("n")).first()
    if n:
        placed = materialize(prefix_in_groups(files, "of", "part", ["key"], "n", "before"), "file-starts")
        tasks = min(MOST_RANGES, n)
        todo = prefix_in_groups(placed, "of", "part", ["key"], "one", "nth").select("part", "key", "before", F.pmod("nth", F.lit(tasks)).cast("int").alias("at"))
        todo.repartitionById(tasks, F.col("at")).mapInArrow(_coded(stage, folder, lengths), "part long").count()
        store, path = _fs(stage)
        store.delete_dir(path)
    return total or 0


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of folder."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.lfids").load(folder).select("content").mapInArrow(_read, schema)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-ids")
    if write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder):
        return read(spark, folder)
    return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
