"""Packing, token-id files, fingerprints and shards against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfield.llm import fingerprints, idfile, packing, sharding, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(library, docs):
    texts = [r.text for r in docs.select("text").collect()] + ["Σας ΣΑΣ", "a<|endoftext|>b", "don't I'LL !'s '' ½ ²x", "a\x1cb", "İ é̀   x", "..'s", "_a_1"]
    for t in texts:
        assert tokens.encode(t, tokens.default_vocabulary()).tolist() == ids_of(library, t)[:-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé'sStdI<|>.,!#1½ \n\t\x1c\xa0ΣσİıḰ"), max_size=30))
def test_encoder_equals_library_on_odd_texts(text):
    known = tokens._chunks(tokens.default_vocabulary())
    assert tokens.encode(text, tokens.default_vocabulary()).tolist() == known.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing(request, library, name):
    df = request.getfixturevalue(name)
    capacity = 256
    rows = packing.pack(df, capacity).collect()
    want = Counter()
    for r in df.collect():
        ids = ids_of(library, r.text)
        for i, a in enumerate(range(0, len(ids), capacity)):
            want[r.doc_id, i, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= -(-sum(r.length for r in rows) // capacity) * 1.05 + 1


def test_packing_climbs_the_tree(spark, docs):
    rows = packing.pack(docs.repartition(40), 512).collect()
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 512) * 1.06


@pytest.mark.parametrize("node", [7, 60])
def test_packing_of_more_bins_than_a_node_takes(docs, monkeypatch, node):
    """Nodes go on side by side, and what they leave is near the bound of whole bins."""
    monkeypatch.setattr(packing, "NODE", node)
    rows = packing.pack(docs.repartition(40), 512).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in packing.pack(docs, 512).collect())
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 512 and len(used) <= -(-sum(used.values()) // 512) * (1.15 if node == 7 else 1.06)


def test_empty_tables(empty):
    assert packing.pack(empty).collect() == []
    assert sharding.shard(empty).collect() == []
    assert fingerprints.fingerprint(empty).collect() == []


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([60, 50, 40, 30, 10]), 100) == [[0, 2], [1, 3, 4]]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_token_ids(request, spark, library, name, tmp_path):
    df = request.getfixturevalue(name)
    from pyspark.sql import functions as F

    total = idfile.write(df, f"file://{tmp_path}/ids", ranges=5)
    rows = sorted(idfile.read(spark, f"file://{tmp_path}/ids").collect(), key=lambda r: r.start)
    start, want = 0, []
    for r in sorted(df.withColumn("t", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.t)):
        ids = ids_of(library, r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in rows] == want and total == start


def test_token_ids_in_several_files_of_a_range(spark, docs, tmp_path, monkeypatch):
    whole = idfile.write(docs, f"file://{tmp_path}/a", ranges=1)
    monkeypatch.setattr(idfile, "FILE", 5000)
    assert idfile.write(docs, f"file://{tmp_path}/b", ranges=3) == whole
    a, b = (idfile.read(spark, f"file://{tmp_path}/{x}").collect() for x in "ab")
    assert Counter(a) == Counter(b) and len(list((tmp_path / "b").glob("*.lfids"))) > 10 and len(list((tmp_path / "a").glob("*.lfids"))) == 1
    assert not list(tmp_path.glob("*-stage"))


def test_no_documents_write_no_file(spark, empty, tmp_path):
    assert idfile.write(empty, f"file://{tmp_path}/none") == 0 and not list(tmp_path.rglob("*.lfids"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(9, 16))
def test_id_file_round_trip(ids, limit):
    ids = np.array(ids, "<u2")
    lengths = idfile.code_lengths(np.bincount(ids, minlength=idfile.SIZE), limit)
    assert lengths.max() <= limit
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
    docs = np.array([(7, 1, len(ids))], idfile._DOC)
    before, back, got = idfile.decode_file(idfile.encode_file(docs, ids, lengths, 5))
    assert before == 5 and back.tolist() == docs.tolist() and got.tolist() == ids.tolist()


def test_id_file_of_many_blocks():
    ids = np.random.default_rng(0).zipf(1.3, 200_001).clip(0, 40_000).astype("<u2")
    lengths = idfile.code_lengths(np.bincount(ids, minlength=idfile.SIZE))
    docs = np.array([(1, 1, len(ids))], idfile._DOC)
    assert (idfile.decode_file(idfile.encode_file(docs, ids, lengths, 0))[2] == ids).all()


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_fingerprints(request, name):
    df = request.getfixturevalue(name)
    from pyspark.sql import functions as F

    rows = sorted(df.withColumn("t", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.t))
    want, similar = [], []
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        want.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        a, b, c = shingles_of(text), shingles_of(edited), shingles_of(after)
        similar.append((len(a & b) / max(1, len(a | b)) if a | b else 1.0, len(a & c) / max(1, len(a | c)) if a | c else 1.0))
    got = fingerprints.fingerprint(df, ranges=6).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.n_chars, r.edited_sha256].append(r)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    for w, (edit, next_) in zip(want, similar):
        assert min(abs(r.near_edited - edit) for r in by[w]) < 0.2 and min(abs(r.near_next - next_) for r in by[w]) < 0.2
    texts = {}
    for r in got:
        text = next(x.text or "" for x in rows if x.doc_id == r.doc_id)
        if list(x.doc_id for x in rows).count(r.doc_id) == 1:
            assert texts.setdefault(text, r.fingerprint) == r.fingerprint
    if name == "docs":
        assert np.mean([abs(by[w][0].near_edited - s[0]) for w, s in zip(want, similar)]) < 0.03


def test_densification_takes_the_first_full_bin_drawn():
    rng = np.random.default_rng(1)
    for full in (1, 2, 9, 200):
        x = np.full((3, fingerprints.BINS), fingerprints.EMPTY)
        for row in x:
            row[rng.choice(fingerprints.BINS, full, replace=False)] = rng.integers(0, 1 << 40, full)
        got = fingerprints.densify(x)
        for row, out in zip(x, got):
            for b in rng.choice(fingerprints.BINS, 40):
                at, t = b, 0
                while row[at] == fingerprints.EMPTY:
                    at, t = int(fingerprints._drawn(np.array([b]), t)[0]), t + 1
                assert out[b] == row[at]
    assert (fingerprints.densify(np.full((1, fingerprints.BINS), fingerprints.EMPTY)) == fingerprints.EMPTY).all()


def test_ranges_part_rows_of_one_id(spark):
    """A null id of a third of all rows, and repeated rows: order, edges and results are those of one range."""
    rows = [(None if i % 3 == 0 else i % 50, f"text {i % 17} of words {i % 5} and more {i}" if i % 4 else "the same text again and again") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(fingerprints.fingerprint(df, ranges=40).collect()) == Counter(fingerprints.fingerprint(df, ranges=1).collect())


def test_one_document_is_followed_by_itself(spark):
    (r,) = fingerprints.fingerprint(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_few_shards(docs):
    rows = sharding.shard(docs, 3).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in rows) and {r.shard for r in rows} == {0, 1, 2} and 3 in {r.grown_shard for r in rows}


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_shards(request, name):
    df = request.getfixturevalue(name)
    rows = sharding.shard(df).collect()
    have = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == have
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def placed_by_hand(spark, ids, shards, salt="shard"):
    """Region, rack and shard by weighted draws, one level after another; the hashes are Spark's."""
    from pyspark.sql import functions as F

    paths = sorted({p for s in shards for p in (s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.name}")})
    rows = ids.select("id", *(F.xxhash64("id", F.lit(f"{salt}/{p}")).alias(p.replace(".", "_")) for p in paths)).collect()
    weight = defaultdict(float)
    for s in shards:
        for p in (s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.name}"):
            weight[p] += s.weight
    out = {}
    for r in rows:
        at = ""
        for depth in range(3):
            below = [p for p in paths if p.count("/") == depth and (not depth or p.startswith(at + "/"))]
            at = min(below, key=lambda p: -np.log((((r[p] & (2**64 - 1)) >> 11) + 0.5) / 2.0**53) / weight[p])
        out[r.id] = int(at.rsplit("/", 1)[1])
    return out


@pytest.mark.parametrize("n", [1, 7, 40, 43])
def test_descent_against_draws_by_level(spark, n):
    from pyspark.sql import functions as F

    ids = spark.range(300)
    got = {r.id: r.s for r in ids.select("id", sharding.place(F.col("id"), sharding.tree_of(n)).alias("s")).collect()}
    assert got == placed_by_hand(spark, ids, sharding.tree_of(n))


@pytest.mark.parametrize("n", [40, 41, 47])
def test_growth_moves_rows_only_into_the_new_shard(spark, n):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(sharding.place(F.col("id"), sharding.tree_of(n)).alias("a"), sharding.place(F.col("id"), sharding.tree_of(n + 1)).alias("b")).collect()
    assert all(r.b in (r.a, n) for r in rows)
    moved = sum(r.b == n for r in rows)
    assert abs(moved - 4000 / (n + 1)) < 6 * (4000 / (n + 1)) ** 0.5
    assert min(Counter(r.a for r in rows).values()) > 4000 / n / 2 and len({r.a for r in rows}) == n


def test_weights_move_only_the_subtree_that_changes(spark):
    from pyspark.sql import functions as F

    old = [sharding.Shard("a", "a1", 0), sharding.Shard("a", "a2", 1), sharding.Shard("b", "b1", 2), sharding.Shard("b", "b1", 3), sharding.Shard("c", "c1", 4)]
    new = [s if s.name != 1 else sharding.Shard("a", "a2", 1, 3.0) for s in old] + [sharding.Shard("d", "d1", 9, 0.0)]
    rows = spark.range(6000).select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).collect()
    assert all(r.b == r.a or r.b in (0, 1) for r in rows)  # into region a; within it only towards the rack that grew
    assert all(r.b in (0, 1) for r in rows if r.a in (0, 1)) and all(r.b == 1 for r in rows if r.a == 1)
    assert abs(sum(r.b == 1 for r in rows) / 6000 - 3 / 7) < 0.04 and abs(sum(r.b == 0 for r in rows) / 6000 - 1 / 7) < 0.04
