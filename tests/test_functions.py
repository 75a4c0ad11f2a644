"""URL and text functions against plain Python."""

import hashlib
import math
import random
import re
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import urldefrag, urljoin, urlparse, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from loomfield.functions import text, twister, urls
from loomfield.operators import blocks, clean, crawl, evaluation

URLS = ["HTTP://Ex.com:80/a/b.md", "https://ex.com/a/b.MD//", "https://ex.com", "https://ex.com/", "https://ex.com/a/?q=1#f", "  https://ex.com/x.md/ ", "https://ex.com/docs;p=1/x;y=2?z", "ftp://ex.com/a",
        "https://ex.com/a/LLMS.txt", "https://ex.com/llms-full.txt/", "https://ex.com/pic.PNG", "//ex.com/a", "/only/path", "https://ex.com/a.md.md", "https://user@ex.com/a//", ""]
TEXTS = ["", " \t", "Hello   World", "ﬁne ﬀ ＡＢＣ", "a b c", "Straße ẞ İ", "`x` and `y z`. Done!", "One. Two 3.5? ok", "See .env now.", "end.\n", "aaaa", "<think>a\nb</think> \"Answer: yes\"", "Σας", "1.5.", "no mark"]


def column(spark, values, c):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", c(F.col("v")).alias("x")).orderBy("i").collect()]


def crawl_url(u):
    p = urlparse(urldefrag(u)[0])
    path = p.path[:-1] if p.path.endswith("/") and len(p.path) > 1 else p.path
    return f"{p.scheme}://{p.netloc}{path}" + (f"?{p.query}" if p.query else "")


def canonical(u):
    p = urlsplit(u.strip())
    path = p.path[:-3] if p.path.lower().endswith(".md") else p.path
    return f"{p.scheme.lower()}://{p.netloc.lower()}{path.rstrip('/') or '/'}"


def test_urls(spark):
    assert column(spark, URLS, urls.crawl_url) == [crawl_url(u) for u in URLS]
    assert column(spark, URLS, urls.canonical_document) == [canonical(u) for u in URLS]
    full = [u for u in URLS if "://" in u]
    assert [canonical(u) for u in full] == [urlunsplit((*urlsplit(canonical(u))[:3], "", "")) for u in full]

    def source(u):
        u = u.strip().rstrip("/")
        return u[:-3] if u.endswith(".md") else u

    assert column(spark, URLS, urls.canonical_source) == [source(u) for u in URLS]
    assert column(spark, URLS, urls.canonical_analysis) == [u.rstrip("/").replace(".md", "") for u in URLS]
    assert column(spark, URLS, urls.is_markdown) == [urlsplit(u).path.lower().endswith(".md") for u in URLS]
    assert column(spark, URLS, urls.is_aggregate) == [urlsplit(u).path.rstrip("/").split("/")[-1].lower() in urls.AGGREGATES for u in URLS]
    allowed = column(spark, URLS, lambda u: urls.is_allowed(u, ["ex.com"], ["/a", "/pic"]))
    assert [u for u, a in zip(URLS, allowed) if a] == ["https://ex.com/a/b.MD//", "https://ex.com/a/?q=1#f", "https://ex.com/a/LLMS.txt", "https://ex.com/a.md.md"]
    assert column(spark, ["x", "", None, "y" * 201, "a\nb"], lambda t: urls.display_title(t, F.lit("https://ex.com/a/b/"))) == ["x", "b", "b", "b", "b"]


def test_text(spark):
    norm = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip()
    assert column(spark, TEXTS, text.normalise_exact) == [norm(t) for t in TEXTS]
    assert column(spark, TEXTS, text.fold_exact) == [norm(t).casefold() for t in TEXTS]
    assert column(spark, TEXTS, text.alnum_exact) == [" ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKC", t).casefold())) for t in TEXTS]
    assert column(spark, TEXTS, text.code_spans) == [re.findall("`([^`]+)`", t) for t in TEXTS]
    assert column(spark, TEXTS, lambda t: text.occurrences(t, F.lit("aa"))) == [t.count("aa") for t in TEXTS]

    def many(t):
        prose = re.sub(r"(?<!\w)\.[A-Za-z][\w.-]*", "", re.sub("`[^`]*`", "", t))
        body = prose[:-1] if prose and prose[-1] in ".!?" else prose
        return bool(re.search(r"[!?]|(?<!\d)\.(?!\d)", body))

    assert column(spark, TEXTS, text.many_sentences) == [many(t) for t in TEXTS]
    assert column(spark, TEXTS, text.clean_generated)[11] == "yes"
    pairs = [("abcd " * 60, "bcda " * 60), ("", ""), ("abc", "abd"), (None, "a")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", text.sequence_ratio("a", "b").alias("r"), text.sequence_ratio_plain("a", "b").alias("p"), text.sequence_bound(F.col("a"), F.col("b")).alias("u")).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        if a is None:
            assert r.r is None
        else:
            assert r.r == SequenceMatcher(None, a, b).ratio() and r.p == SequenceMatcher(None, a, b, autojunk=False).ratio() <= r.u


def test_hashes(spark):
    names = ["claude_code_en", "x", "é", ""]
    want = [42 + int.from_bytes(n.encode(), "little") % 1_000_003 for n in names]
    assert column(spark, names, lambda n: text.source_seed(42, n)) == want and want[0] == 42 + 577666
    got = column(spark, TEXTS, lambda t: text.stable_fraction(7, t))
    assert got == [int.from_bytes(hashlib.sha256(f"7|{t}".encode()).digest()[:8], "big") / 2**64 for t in TEXTS]


def test_excerpts(spark):
    words = ["`Alpha`", "gamma:"]
    near, far = "x " * 300 + "alpha beta gamma" + " y" * 300, "alpha" + " z" * 2000 + " gamma"
    a, b, c = column(spark, [near, far, "alpha only"], lambda t: text.excerpt(t, F.array(*map(F.lit, words))))
    at = near.index("alpha")
    assert a == near[at - 180 : at + 16 + 180] and c is None
    assert b == f"{far[:185]} […] {far[far.index('gamma') - 140:]}"


def test_additions(spark):
    original = "Use the `run --all` form when every module has to be built again from the start."
    good = "This also rebuilds modules that did not change since the last time it was started."
    for exact in (True, False):
        rows = column(spark, [good, "Short.", good[:-1], "It will always ensure `new` --flag results for all of the modules in there."], lambda t: text.addition_violations(t, F.lit(original), exact))
        assert rows == [[], ["combined_length", "length"], ["no_end_mark"], ["flag", "new_code", "overclaim"]]
    street = "Die Straße vor dem Haus ist heute gesperrt, weil dort eine Baustelle ist und niemand fahren darf, auch kein Rad."
    (found,) = column(spark, ["DIE STRASSE VOR DEM HAUS IST HEUTE GESPERRT, WEIL DORT"], lambda t: text.addition_violations(t, F.lit(street)))
    assert "repeats" in found


def test_folded_case(spark):
    df = spark.createDataFrame([("Die STRASSE ist lang.", ["`Straße`"]), ("Kein Wort", ["Straße"]), (None, ["a"]), ("x", None)], "t string, k array<string>")
    got = [tuple(r) for r in df.select(text.holds_all(F.col("t"), F.col("k"), exact=True), text.excerpt(F.col("t"), F.col("k"), exact=True)).collect()]
    assert got[0] == (False, "Die STRASSE ist lang.") and got[1] == (False, None) and got[2][1] is None and got[3] == (None, None)
    assert df.limit(1).select(text.holds_all(F.col("t"), F.array(F.lit("straße")), exact=True)).first()[0] is True


def test_rounding_half_to_even(spark):
    values = [2.675, 0.5, 1.5, 2.5, -2.5, 1.005, 1e20, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 2):
        assert [r[0] for r in df.select(text.rounded(F.col("v"), places)).collect()] == [None if v is None else round(v, places) for v in values]


def test_keys_and_paths(spark):
    good = spark.createDataFrame([(" a = /x=y ",), ("b=z",)], "spec string")
    assert sorted((r.key, r.path) for r in text.keys_and_paths(good, "spec").collect()) == [("a", "/x=y"), ("b", "z")]
    for bad in ("none", "=x", "x= ", "b=again"):
        with pytest.raises(ValueError):
            text.keys_and_paths(good.unionByName(spark.createDataFrame([(bad,)], "spec string")), "spec")
    with pytest.raises(ValueError):
        text.keys_and_paths(spark.createDataFrame([(None,)], "spec string"), "spec")


def test_percentiles(spark):
    df = spark.createDataFrame([("four", v) for v in (4, 2, 3, 1)] + [("one", 9)], "g string, v int")
    ranks = {"a": evaluation.nearest_rank_of(0.5), "b": evaluation.nearest_rank_of(0.95), "c": evaluation.floor_rank_of(50)}
    assert {r.g: (r.a, r.b, r.c) for r in evaluation.at_ranks(df, "v", ("g",), ranks).collect()} == {"four": (2, 4, 3), "one": (9, 9, 9)}


def test_pages(spark):
    page = '<html><head><title> </title><style>x</style></head><body><nav><a href="/n">n</a></nav><h1>Head <b>line</b></h1><main><p>One<br>two</p><script>1</script><a href="a/b?x#y">go</a><a href=\'#f\'>f</a></main></body></html>'
    df = spark.createDataFrame([(1, "https://ex.com/d/p", page), (2, "https://ex.com/d/q", "plain"), (3, "https://ex.com/", None)], "page_id long, url string, html string")
    rows = crawl.extracted(df).orderBy("page_id").collect()
    assert rows[0].title == "Head line" and rows[0].content == "One\ntwo\ngo\nf" and rows[1].content == "plain" and rows[1].title == "q" and rows[2].content == ""
    links = df.where("page_id = 1").select(crawl.resolved_links(F.col("html"), F.col("url")).alias("l")).first().l
    assert links == [urldefrag(urljoin("https://ex.com/d/p", h))[0] for h in ("/n", "a/b?x#y")]


def test_references_against_bases(spark):
    """As urllib's urljoin, without fragments."""
    refs = ["x", "../x", "./x", "/x/../y", "..", ".", "../", "?a=b", "//h.org/z/../q", "http://h.org/a/../b", "HTTPS://H.org", "mailto:a@b", "a//b", "../../../..", "x/./y/", "/", "//h.org", "x?y=../z", "./", "../.", "b/../../c", "/..", "?", "x#f?g", "/a;p/../b", "http:x"]
    bases = ["http://e.org", "http://e.org/", "http://e.org/a", "http://e.org/a/", "https://e.org/a/b/c?q=1#f", "http://e.org/a//b/../c", "", None]
    rng = random.Random(5)
    rows = [(r, b) for r in refs for b in bases] + [("".join(rng.choice(["a", "..", ".", "/", "/", "b", "?"]) for _ in range(rng.randrange(1, 9))), rng.choice(bases[:-2])) for _ in range(1500)]
    got = spark.createDataFrame(rows, "r string, b string").select("r", "b", urls.resolve(F.col("r"), F.col("b")).alias("x")).collect()
    assert [(g.r, g.b, g.x) for g in got] == [(g.r, g.b, urldefrag(urljoin(g.b, g.r))[0]) for g in got]


def test_links_of_every_form(spark):
    page = "<a href='?q=1&amp;r=2'>a</a><A class=x HREF=\"../../up/./x#y\">b</A><a href='//h.org/p'>c</a><a href=''>d</a><a href=' javascript:x()'>e</a><a name='n'>f</a>"
    df = spark.createDataFrame([("https://e.org/a/b/c", page), (None, page), ("https://e.org", None)], "url string, html string")
    got = [r.l for r in df.select(crawl.resolved_links(F.col("html"), F.col("url")).alias("l")).collect()]
    assert got == [["https://e.org/a/b/c?q=1&r=2", "https://e.org/up/x", "https://h.org/p"], ["?q=1&r=2", "../../up/./x", "//h.org/p"], None]


def test_reasons(spark):
    rows = [(1, None, "u"), (2, " ", "u"), (3, "x" * 900, None), (4, "x" * 900, "https://a/llms.txt"), (5, "x" * 799, "https://a/b"), (6, " " + "x" * 799, "https://a/b")]
    df = spark.createDataFrame(rows, "doc_id long, content string, url string")
    got = df.select("doc_id", clean.reason(F.col("content"), F.col("url"), 800).alias("r")).orderBy("doc_id").collect()
    assert [r.r for r in got] == ["missing_content", "missing_content", "missing_url", "aggregate_document", "short_stub", None]


def test_survivors_prefer_markdown_then_length_then_url(spark):
    body = "word " * 300
    rows = [(1, body, "https://a/x"), (2, body, "https://a/x.md"), (3, body + "more", "https://a/y"), (4, body + "more than that", "https://a/y?z"), (5, body + "more", "https://a/y/"), (6, None, "https://a/z")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, content string, url string, seed_name string")
    got = {r.doc_id: r.reason for r in clean.clean(df, 800, exact=True).collect()}
    assert got == {1: "exact_content_duplicate", 2: None, 3: "exact_content_duplicate", 4: None, 5: "canonical_url_duplicate", 6: "missing_content"}
    assert clean.excluded(df, 800).count() == 4


def test_blind_map_is_pythons_shuffle(spark):
    models = ["a", "b", "c", "d"]
    df = spark.createDataFrame([("q1",), ("q2",)], "id string")
    got = {}
    for r in evaluation.blind_map(df, models, 20260815).collect():
        got.setdefault(r.id, {})[r.letter] = r.model
    for i in ("q1", "q2"):
        m = list(models)
        random.Random(int.from_bytes(hashlib.sha256(f"20260815:{i}".encode()).digest()[:8], "big")).shuffle(m)
        assert got[i] == dict(zip("ABCD", m))


def test_bootstrap(spark):
    rows = [("s", "c", "j", i, float(d)) for i, d in enumerate([1, -1, 2, 0, 3, 1, 1])]
    got = evaluation.bootstrap(spark.createDataFrame(rows, "split string, comparison string, judge string, id long, delta double"), resamples=200).first()
    rng, x = random.Random(20260815), [r[4] for r in rows]
    means = sorted(sum(x[rng.randrange(7)] for _ in range(7)) / 7 for _ in range(200))
    assert (got.ci95_low, got.ci95_high) == (means[5], means[195]) and got.significant == (means[5] > 0 or means[195] < 0)


@pytest.mark.parametrize("segment", [1 << 24, 100, 2_000])
def test_bootstrap_by_any_segments(spark, monkeypatch, segment):
    """The same intervals however the sequence of words is cut, to the last bit."""
    monkeypatch.setattr(evaluation, "SEGMENT", segment)
    rng = random.Random(3)
    cells = {("s", "c", "j"): [rng.random() for _ in range(23)], ("s", "c", "k"): [float(rng.randrange(-3, 4)) for _ in range(64)], ("t", "c", "j"): [0.5], (None, "c", "j"): [1.0, 2.0], ("s", "d", "j"): [rng.gauss(0, 1) for _ in range(31)]}
    rows = [(*c, i, x) for c, v in cells.items() for i, x in enumerate(v)] + [("s", "c", "j", 99, None), ("none", "c", "j", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "split string, comparison string, judge string, id long, delta double").repartition(3)
    got = {(r.split, r.comparison, r.judge): (r.ci95_low, r.ci95_high, r.significant) for r in evaluation.bootstrap(df, 11, 200).collect()}
    want = {}
    for c, x in cells.items():
        draw = random.Random(11).randrange
        means = sorted(sum(x[draw(len(x))] for _ in x) / len(x) for _ in range(200))
        want[c] = (means[5], means[195], means[5] > 0 or means[195] < 0)
    assert got == want


def test_bootstrap_holds_no_cell_in_a_row(spark, monkeypatch):
    """A row that is stored or sent has a bounded part of a cell's deltas; cells of one size are drawn together."""
    stored = []
    monkeypatch.setattr(evaluation, "materialize", lambda df, tag, own=evaluation.materialize: stored.append(own(df, tag)) or stored[-1])
    monkeypatch.setattr(evaluation, "SEGMENT", 5_000)
    monkeypatch.setattr(evaluation, "BUNDLE", 2_500)
    rng = random.Random(4)
    cells = {("s", "c", j): [float(rng.randrange(-3, 300)) if j != "third" else rng.random() for _ in range(1_100)] for j in ("first", "second", "third", "fourth")}
    rows = [(*c, 7 * i, x) for c, v in cells.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "split string, comparison string, judge string, id long, delta double").repartition(3)
    got = {(r.split, r.comparison, r.judge): (r.ci95_low, r.ci95_high) for r in evaluation.bootstrap(df, 11, 40).collect()}
    for c, x in cells.items():
        draw = random.Random(11).randrange
        means = sorted(sum(x[draw(len(x))] for _ in x) / len(x) for _ in range(40))
        assert got[c] == (means[1], means[39])
    arrays = [(t, c) for t in stored for c, kind in t.dtypes if kind == "array<double>"]
    assert arrays and max(t.agg(F.max(F.size(c))).first()[0] for t, c in arrays) <= 256


@pytest.mark.parametrize("words", [0, 1, 623, 624, 70_000, 80_000, 123_457])
def test_jumps_of_the_generator(words):
    state = twister.seeded(20260815)
    rng = random.Random(20260815)
    for _ in range(words):
        rng.getrandbits(32)
    assert twister.generator(twister.jumped(state, words)).integers(0, 1 << 32, 700, dtype="uint32").tolist() == [rng.getrandbits(32) for _ in range(700)]


def test_jumps_add_up():
    state = twister.seeded(5)
    far, near = twister.jumped(state, 10**12 + 10**6), twister.jumped(twister.jumped(state, 10**12), 10**6)
    give = lambda s: twister.generator(s).integers(0, 1 << 32, 700, dtype="uint32").tolist()
    assert give(far) == give(near)


def test_pearson_without_variance(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("b", 1, 2), ("b", 2, 4)], "g string, x int, y int")
    got = {r.g: r.r for r in evaluation.pearson(df, "x", "y", "g").collect()}
    assert got["a"] != got["a"] and abs(got["b"] - 1) < 1e-12


def test_judge_problems(spark):
    good = '{"winner": "Candidate A", "scores": {"Candidate A": 7, "Candidate B": 1.5}, "reason": "r"}'
    rows = [good, good.replace("7", "11"), good.replace("7", "true"), good.replace("7", '"7"'), good.replace('"winner": "Candidate A"', '"winner": "C"'), good.replace(', "Candidate B": 1.5', ""), good.replace('"r"', '" "'), "no json"]
    got = column(spark, rows, lambda r: evaluation.judge_problems(r, ["A", "B"]))
    assert got[:5] == [[], ["score_values"], ["score_values"], ["score_values"], ["winner"]] and "score_keys" in got[5] and got[6] == ["reason"] and "winner" in got[7]


def test_templates(spark):
    df = spark.createDataFrame([("q{a}", "x")], "q string, a string")
    assert df.select(blocks.template("Q: {q} A", q=F.col("q")).alias("t")).first().t == "Q: q{a} A"
    assert df.select(blocks.template("{q}{a}{b}", a=F.col("a"), q=F.col("q")).alias("t")).first().t == "q{a}x{b}"


def test_instruction_examples_need_an_answer_token(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<int>, a array<int>")
    made = lambda n, strict=True: df.select(blocks.instruction_example(F.col("p"), F.col("a"), 9, n, strict).alias("x")).first().x
    assert made(4).labels == [-100, -100, -100, 4] and made(9).ids == [1, 2, 3, 4, 5, 9] and made(3, False).labels == [-100] * 3
    with pytest.raises(Exception, match="no answer token"):
        made(3)


def test_pluggable_tokenizer(spark):
    df = spark.createDataFrame([("a bb",), (None,), ("",)], "t string")
    got = df.select(blocks.token_ids(F.col("t"), lambda: lambda texts: [[len(w) for w in t.split()] for t in texts])).collect()
    assert [r[0] for r in got] == [[1, 2], [], []]


def test_patches_that_do_not_apply(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, q string")
    fix = lambda *f: spark.createDataFrame(list(f), "id long, value string")
    assert sorted(map(tuple, clean.patched(rows, fix((2, "new")), "id", "q").collect())) == [(1, "a"), (2, "new")]
    for bad in ([(3, "x")], [(1, "x"), (1, "y")], [(1, "x" * 1001)]):
        with pytest.raises(ValueError):
            clean.patched(rows, fix(*bad), "id", "q")
    with pytest.raises(ValueError):
        clean.patched(rows.unionByName(rows), fix((1, "x")), "id", "q")


def test_ranks_of_groups(spark):
    rows = [("a", v) for v in (5, 1, 1, 3, None)] + [("b", 7), ("c", None), (None, 2), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: (r.low, r.high) for r in evaluation.at_ranks(df, "v", ("g",), {"low": evaluation.nearest_rank_of(0.5), "high": evaluation.floor_rank_of(95)}).collect()}
    assert got == {"a": (1, 5), "b": (7, 7), None: (2, 4)}
    timed = {r.g: (r["count"], r.p95_seconds) for r in evaluation.timing(df, "v", "g").collect()}
    assert timed == {"a": (4, 5), "b": (1, 7), "c": (0, None), None: (2, 4)}
    assert evaluation.timing(df, "v").first().p95_seconds == 7 and {r.g: r.p95 for r in evaluation.lengths(df, "g", "v").collect()}[None] == 4


def test_exposure(spark):
    corpus = spark.createDataFrame([("aaa b",), ("aa",), (None,), ("",), ("b\ue000b",)], "text string")
    items = spark.createDataFrame([(1, ["aa", "b"]), (2, ["zz"]), (3, []), (4, None)], "id long, keywords array<string>")
    got = {r.id: (r.min_occurrences, r.total_occurrences, r.log_min_occurrences) for r in evaluation.exposure(items, corpus).collect()}
    assert got == {1: (2, 5, math.log1p(2)), 2: (0, 0, 0.0)}
    counted = {r.k: r.n for r in evaluation.occurrences_in(corpus, ["", "b\ue000"]).collect()}
    assert counted == {"": 6 + 3 + 1 + 4, "b\ue000": 1}
    scores = spark.createDataFrame([(1, 2.0, 5.0), (2, 3.0, 1.0)], "id long, base double, tuned double")
    exposed = evaluation.exposure(items, corpus)
    assert {r["count"]: (r.n, round(r.r, 9)) for r in evaluation.exposure_correlations(exposed, scores.withColumnRenamed("tuned", "score")).collect()} == {"min_occurrences": (2, 1.0), "total_occurrences": (2, 1.0)}
    assert {r.bucket: (r.items, r.delta) for r in evaluation.exposure_buckets(exposed, scores).collect()} == {"0": (1, -2.0), "1-4": (1, 3.0)}


@pytest.mark.parametrize("length", [1, 4, 7])
def test_packing_conserves_tokens(spark, length):
    docs = spark.createDataFrame([("train", f"u{i}", list(range(i))) for i in range(9)] + [("test", "v", [5, 6])], "split string, canonical_url string, ids array<int>")
    rows = blocks.pack(docs, length, -1, -2).collect()
    stats = {r.split: r for r in blocks.pack_stats(docs.select("split", F.size("ids").alias("n")), length).collect()}
    for split in ("train", "test"):
        own = sorted((r for r in rows if r.split == split), key=lambda r: r.block)
        s = stats[split]
        assert [r.block for r in own] == list(range(s.blocks)) and all(len(r.input_ids) == len(r.attention_mask) == length for r in own)
        flat = [i for r in own for i in r.input_ids]
        assert s.content_tokens + s.eos_tokens + s.padding_tokens == s.blocks * length == len(flat)
        assert flat.count(-1) == s.eos_tokens and flat.count(-2) == s.padding_tokens and sum(m for r in own for m in r.attention_mask) == s.non_padding_tokens
        order = sorted((int.from_bytes(hashlib.sha256(f"42|{split}|{u}".encode()).digest()[:8], "big"), ids) for sp, u, ids in docs.collect() if sp == split)
        assert flat[: s.non_padding_tokens] == [t for _, ids in order for t in [*ids, -1]]
