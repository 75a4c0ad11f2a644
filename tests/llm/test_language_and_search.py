"""Language identification, importance resampling and ranked search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfield.llm import langid, lexical, quality, registry, resampling, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def words_of(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["lo", "Ipsum", "dolor", "été", "sit", "amet4", "x" * 70, "ÄÖ", "über", "no", "12"], n))


TIED = words_of(40, 1)
MANY = [(i, words_of(5 + i, i)) for i in range(40)] + [(100 + i, TIED) for i in range(30)] + [(200, TIED), (200, TIED), (None, TIED), (None, TIED), (7, None), (8, ""), (9, "..."), (10, "one " * 30_000)]
ITEMS = [(1, "dolor sit, AMET4!"), (2, "über " + "x" * 70), (3, "..."), (4, None), (None, "dolor"), (5, "nowhere"), (6, "no 12"), (6, "no été"), (7, words_of(25, 3))]


# ---------------------------------------------------------------- resampling


def test_crc_of_words_and_pairs():
    texts = ["Ab c, d  é", "", "one", "z" * 200 + " " + "y" * 65 + " b", "a b"]
    for i, raw, at in words.chunks(pa.array(texts)):
        values, ptr, per = resampling.features(raw, at)
        for j in range(len(at) - 1):
            w = terms_of(texts[i + j])
            want = [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
            assert values[ptr[j] : ptr[j + 1]].tolist() == sorted(want) and per[j] == len(w)


def drawn(docs, target, percent=25, least=20):
    def features(text):
        w = terms_of(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)

    s, t = (Counter(b for text in of for b in features(text)[0]) for of in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10_000.0) / ((s[b] + 1.0) * (t.total() + 10_000.0))))
    rows = []
    for i, text in docs:
        f, n = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    some = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    place = {id(r): k + 1 for k, r in enumerate(some[: percent * len(some) // 100])}
    return Counter((*r[:4], place.get(id(r))) for r in rows)


@pytest.mark.parametrize("percent", [25, 60, 100, 0])
def test_resampling(spark, percent):
    docs, target = spark.createDataFrame(MANY, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = resampling.resample(docs, target, percent, keep=["doc_id"])
    assert Counter(map(tuple, got.collect())) == drawn(MANY, [t for _, t in ITEMS], percent)


def test_resampling_odd_rows(odd, empty, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = resampling.resample(odd, empty, 50, least_words=2)
    assert [c for c in odd.columns if c.lower() != "score"] + ["n_features", "weight", "score", "rank"] == got.columns
    assert Counter((r.doc_id, r.n_features, r.weight, r["score"], r["rank"]) for r in got.collect()) == drawn(rows, [], 50, 2)
    assert {(r.doc_id, r.text, r.size) for r in got.collect()} == {(*x, "mine") for x in rows}
    assert resampling.resample(empty, odd).collect() == []


# ---------------------------------------------------------------- ranked search


def best(docs, items, k):
    sets = [(i, Counter(terms_of(t))) for i, t in docs]
    sets = [(i, c) for i, c in sets if c]
    n, total = len(sets), sum(c.total() for _, c in sets)
    df = Counter(w for _, c in sets for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms_of(t))
    out = Counter()
    for item, own in asked.items():
        rows = []
        for i, c in sets:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in own if w in c)
            if s > 0 and i is not None:
                rows.append((-s, i))
        out.update((item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k]))
    return out


@pytest.mark.parametrize("k", [1, 5, 50])
@pytest.mark.parametrize("parts", [1, 3])
def test_search(spark, monkeypatch, k, parts):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 1 << 20 if parts == 1 else 100)
    monkeypatch.setattr(lexical, "SHARD", 1 << 9)
    docs, items = spark.createDataFrame(MANY, "doc_id long, text string").repartition(parts), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(map(tuple, lexical.ranked(docs, items, k).collect())) == best(MANY, ITEMS, k)


def test_search_odd_rows(odd, empty, docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    asked = odd.select("doc_id", "text", "key")
    assert Counter(map(tuple, lexical.ranked(odd, asked, 4).collect())) == best(rows, rows, 4)
    assert lexical.ranked(empty, asked).collect() == [] and lexical.ranked(odd, empty).collect() == []


def test_search_leaves_out_postings():
    """Where rare terms decide, common ones are only probed for the documents that can still be among the best."""
    rng = np.random.default_rng(2)
    texts = [("common " * int(rng.integers(0, 4))) + f"w{i}" + (" rare" * (1 + i % 5) if i % 100 == 0 else "") for i in range(5000)]
    q = lexical.Queries.of(np.array([1]), pa.array(["common rare"]))
    (_, raw, at), *more = words.chunks(pa.array(texts), 1 << 30)
    p = lexical.postings(raw, at, np.ones(len(texts), bool), q.hashes)
    shard = {c: np.asarray(p[c]) for c in ("sizes", "terms", "ends", "docs", "tf")} | {"ids": p["docs_of"]}
    q.n_docs, q.n_terms = p["n_docs"], p["n_terms"]
    q.weight = np.array([math.floor(1000 * math.log((2 * q.n_docs + 2) / (2 * int(d) + 1))) for d in p["df"]])
    want = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    q.floor = np.zeros(1, np.int64)
    every = lexical.search(q, shard, 10, want)
    q.floor = want[0][0][-1:]
    got = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    assert not more and lexical.search(q, shard, 10, got) < every / 10
    assert got[0][0].tolist() == want[0][0].tolist() and got[0][1].tolist() == want[0][1].tolist()


def test_lengths_beyond_64_bits():
    assert lexical.lengths(np.array([3, 1 << 40]), 1 << 30, 1 << 50).tolist() == [50 + 50 * 3 * (1 << 30) // (1 << 50), 50 + 50 * (1 << 40) * (1 << 30) // (1 << 50)]


# ---------------------------------------------------------------- language


def kneser_ney(texts, order):
    """Bits of a word's characters after blanks, by the textbook recursion."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = " " * (order - 1) + w + " "
            counts[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        types = {g[order - n - 1 :] for g in counts[order]}
        counts[n].update(g[1:] for g in types)
    discount = [0.5] * (order + 1)
    for n in range(1, order + 1):
        n1, n2 = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5))

    def p(context, c, base):
        if not context and c is None:
            return base
        own = {g: k for g, k in counts[len(context) + 1].items() if g[:-1] == context}
        lower = p(context[1:], c, base) if context else base
        if not own:
            return lower
        s, d = sum(own.values()), discount[len(context) + 1]
        return max(own.get(context + c, 0) - d, 0) / s + d * len(own) / s * lower

    return p


def test_character_models(spark):
    texts = [("der die und Straße ist das", "de"), ("the thing of that and", "en"), ("the the is", "en"), ("und und der", "de")]
    model = langid.train(spark.createDataFrame(texts, "text string, lang string"), F.lit(True), order=3)
    assert model.languages == ["de", "en"] and model.base == 1 / (1 + len({c for t, _ in texts for c in t.lower()}))
    asked = ["Der thing", "ß", "été the 12 die", "und"]
    n, bits = langid.measure(pa.array(asked), model.load(["de", "en"]), 3, model.base)
    for j, lang in enumerate(("de", "en")):
        p = kneser_ney([t for t, own in texts if own == lang], 3)
        for i, t in enumerate(asked):
            places = [("  " + w + " ", k) for w in re.findall(r"[^\W\d_]+", t.lower()) for k in range(2, len(w) + 3)]
            assert n[i] == len(places)
            assert bits[i, j] / langid.UNIT == pytest.approx(sum(-math.log2(p(s[k - 2 : k], s[k], model.base)) for s, k in places), abs=1e-4)


def test_language_models_leave_rare_grams_to_lower_orders(spark):
    grams = spark.createDataFrame([("x", " ab", 900), ("x", "abc", 90), ("x", "abd", 1)], "lang string, gram string, k long")
    every, some = ({r.gram: r for r in langid.tables(grams, 3, share).collect()} for share in (0.0, 0.01))
    assert "abd" in every and "abd" not in some and set(some) < set(every)
    for r in some.values():
        n = len(r.gram)
        kept = sum(x.kept for g, x in some.items() if len(g) == n and g[:-1] == r.gram[:-1])
        assert r.left == pytest.approx(1 - kept)


@pytest.mark.parametrize("most", [langid.MOST_ENTRIES, 10])
def test_languages_of_odd_rows(spark, odd, empty, docs, most, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ENTRIES", most)
    model = langid.train(docs, F.lit(True))
    assert model.languages == ["de", "en", "es", "fr"] and len(model.parts) == (1 if most > 10 else 4)
    got = langid.identify(odd, model).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in odd.collect())
    for r in got:
        assert r.size == "mine" and 0 <= r["score"] <= 1
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and (r.cross_entropy is None) == (not lettered)
    assert langid.identify(empty, model).collect() == []
    (one,) = langid.identify(spark.createDataFrame([("und das ist die Straße der Einheit, schön und schlicht",)], "text string"), model).collect()
    assert one.lang_pred == "de"
    strange = spark.createDataFrame([("Хорошо это очень странный текст " * 20,), ("Is and of the thing that are by the for and " * 5,)], "text string")
    found = {r.text[0]: r for r in langid.identify(strange, model).collect()}
    assert not found["Х"].accepted and found["I"].accepted


def test_languages_without_learning_texts(odd, empty):
    for model in (langid.train(empty, F.lit(True)), langid.train(odd, F.lit(False))):
        assert {(r.lang_pred, r["score"], r.accepted) for r in langid.identify(odd, model).collect()} == {("und", 0.0, False)}
    assert {r.lang_pred for r in langid.identify(odd, langid.train(odd, F.col("lang") == "de")).collect()} == {"de", "und"}


def test_language_query(spark, docs, tmp_path):
    """Held-out labels, sources and ids don't matter; held-out texts are told right."""
    out = langid.held_out(F.col("doc_id"))
    changed = docs.withColumns({"lang": F.when(out, "xx").otherwise(F.col("lang")), "source": F.lit("?")})
    changed.write.parquet(f"{tmp_path}/documents.parquet")
    first = langid.op11_language_id(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, langid.op11_language_id(spark, str(tmp_path)).collect()))
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in first)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in first if r.held_out]) >= 0.95
    assert {r.lang_pred for r in first} <= {*want.values(), "und"}


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert Counter(map(plain, got.select(*names).collect())) == Counter(map(plain, cur.fetchall()))


# ---------------------------------------------------------------- quality


def test_quality_query(spark, docs, tmp_path):
    """Held-out labels, languages, sources and ids don't matter; scores are those of the rules by hand; the threshold is 0.3."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int")).write.parquet(f"{tmp_path}/labels.parquet")
    docs.withColumns({"lang": F.lit("?"), "source": F.lit("?")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, quality.op10_quality(spark, sf).collect()))
    assert got == sorted(map(tuple, quality.op10_quality(spark, str(tmp_path)).collect())) and len(got) == docs.count()
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    stats = quality.statistics(pa.array([texts[g[0]] for g in got]))
    for (i, held, score, predicted), x in zip(got, stats):
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all((x[f] > cut) == above for f, above, cut in rule))
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and predicted == (score >= 0.3)


def test_quality_without_documents(spark, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(empty, labels)
    assert model.rules == [] and model.probability(np.zeros((1, len(quality.STATISTICS))))[0] < 0.01
    assert empty.select(model.compiled(quality.measured()).alias("s")).collect() == []
