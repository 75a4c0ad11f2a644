"""Splits, duplication, leakage, sources and the driver's contract."""

import hashlib
import json
import random
import re
from difflib import SequenceMatcher
from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfield.functions import text
from loomfield.operators import blocks, crawl, duplication, leakage, nearest, split, verify
from loomfield.plans import reports
from loomfield.sources import tables

SF = "/root/testdata/sf0.001"


def greedy(docs, ratio, seed):
    """docs: (url, tokens, forced). By the rule as it is worded."""
    fraction = lambda u: int.from_bytes(hashlib.sha256(f"{seed}|{u}".encode()).digest()[:8], "big") / 2**64
    docs = sorted(docs)
    free = [d for d in docs if not d[2]]
    if len(free) < 2:
        return set()
    target = round(sum(d[1] for d in docs) * ratio)
    test = {d[0] for d in free if fraction(d[0]) < ratio} or {min(free, key=lambda d: fraction(d[0]))[0]}
    if len(test) == len(free):
        test.remove(max(free, key=lambda d: fraction(d[0]))[0])
    tokens = {d[0]: d[1] for d in free}
    while True:
        total = sum(tokens[u] for u in test)
        if total < target:
            options = [(abs(target - total - tokens[u]), i, u) for i, u in enumerate(tokens) if u not in test]
        else:
            options = [(abs(target - total + tokens[u]), i, u) for i, u in enumerate(sorted(test))] if len(test) > 1 else []
        if not options or min(options)[0] >= abs(target - total):
            return test
        test ^= {min(options)[2]}


@pytest.mark.parametrize("urls", [4, 1])
def test_split_against_the_rule(spark, monkeypatch, urls):
    monkeypatch.setattr(split, "URLS", urls)
    rows = [(f"s{i % 4}", f"https://s{i % 4}/{i}", 10 + i * 37 % 400, i % 9 == 0) for i in range(90)] + [("one", "https://one/1", 50, False), ("none", "https://none/1", 50, True)]
    rows += [("same", f"https://same/{i:03d}", 7, False) for i in range(60)] + [("big", f"https://big/{i:03d}", 5 if i else 5000, False) for i in range(50)]  # many moves of one size
    df = spark.createDataFrame(rows, "seed_name string, canonical_url string, token_count int, qa_source boolean")
    got = {r.canonical_url: r.split for r in split.split(df).collect()}
    assert len(got) == len(rows)
    for source in {r[0] for r in rows}:
        seed = 42 + int.from_bytes(source.encode(), "little") % 1_000_003
        want = greedy([r[1:] for r in rows if r[0] == source], 0.25, seed)
        assert {u for u in got if u.split("/")[2] == source and got[u] == "test"} == want
    assert not any(got[r[1]] == "test" for r in rows if r[3])


def by_hand(target, tokens, test):
    """One document at a time, all of them tried; tokens by URL."""
    test = set(test)
    while True:
        total = sum(tokens[u] for u in test)
        if total < target:
            options = [(abs(target - total - n), u) for u, n in tokens.items() if u not in test]
        else:
            options = [(abs(target - total + tokens[u]), u) for u in test] if len(test) > 1 else []
        if not options or min(options)[0] >= abs(target - total):
            return test
        test ^= {min(options)[1]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=2, max_size=14), st.integers(0, 200), st.integers(1, 3), st.data())
def test_moves_by_token_counts(sizes, target, urls, data):
    tokens = {f"u{i:02d}": n for i, n in enumerate(data.draw(st.permutations(sizes)))}
    start = {f"u{i:02d}" for i in data.draw(st.sets(st.sampled_from(range(len(sizes))), min_size=1))}
    while True:
        sides = split._Side(), split._Side()
        for k, side in enumerate(sides):
            for n in set(tokens.values()):
                if own := sorted(u for u in tokens if tokens[u] == n and (u in start) == (k == 0)):
                    side.add(n, len(own), own[:urls])
        try:
            changed = split._towards(target, *sides)
            break
        except split._Unknown:
            urls += 1
    end = start ^ changed
    assert end == by_hand(target, tokens, start)
    assert end and abs(target - sum(tokens[u] for u in end)) <= abs(target - sum(tokens[u] for u in start))


def test_near_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.lang, r.a, r.b) for r in duplication.near_pairs(duplication.shingle_table(docs, "lang", "doc_id"), "lang", "doc_id").collect()}
    sets = {}
    for r in docs.collect():
        w = r.text.split()
        sets[r.doc_id] = (r.lang, {" ".join(w[i : i + 8]) for i in range(max(1, len(w) - 7))})
    want = set()
    for a, (la, sa) in sets.items():
        for b, (lb, sb) in sets.items():
            n = len(sa & sb)
            if a < b and la == lb and n and (n / len(sa | sb) >= 0.3 or n / min(len(sa), len(sb)) >= 0.6):
                want.add((la, a, b))
    assert got == want


def test_denied_outputs_in_any_case(spark):
    said = ["rm -rf /", "RM -RF /", "please GIT RESET --HARD", "Kill -9 1", "CHMOD 777", "x\nanswer: y", "harm -rf", "git  Clean -xdF", "DOCKER system\tPRUNE"]
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", text.matching(F.col("t"), text.DENIED_OUTPUTS).alias("found"))
    want = {t: [n for n, p in text.DENIED_OUTPUTS.items() if re.search(p, t, re.IGNORECASE)] for t in said}
    assert {r.t: r.found for r in df.collect()} == want and sum(map(bool, want.values())) == 8


@pytest.mark.parametrize("length", [1, 4, 7])
def test_blocks_of_documents_of_any_length(spark, length):
    docs = [("a", f"u{i}", list(range(100 * i, 100 * i + n))) for i, n in enumerate([0, 1, 3, 4, 7, 50, 8])]
    df = spark.createDataFrame(docs, "split string, canonical_url string, ids array<int>")
    begin = {r.canonical_url: r.start for r in blocks.starts(df.select("split", "canonical_url", F.size("ids").alias("n"))).collect()}
    stream = [t for _, u, ids in sorted(docs, key=lambda x: begin[x[1]]) for t in [*ids, -5]]
    got = sorted((r.block, r.input_ids, r.attention_mask) for r in blocks.pack(df, length, -5, -1).collect())
    assert [b for b, *_ in got] == list(range(-(-len(stream) // length))) and all(len(x) == len(m) == length for _, x, m in got)
    assert [t for _, x, m in got for t, on in zip(x, m) if on] == stream and all(t == -1 for _, x, m in got for t, on in zip(x, m) if not on)


def brute_pairs(texts, k=8, similarity=0.3, containment=0.6):
    """{(group, a, b, shared, union, least)} of (group, key, text)."""
    sets = [(g, i, {" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := (t or "").split()) else {""}) for g, i, t in texts if g is not None and t is not None]
    out = set()
    for g, a, x in sets:
        for h, b, y in sets:
            n = len(x & y)
            if g == h and a < b and n and (n / len(x | y) >= similarity or n / min(len(x), len(y)) >= containment):
                out.add((g, a, b, n, len(x | y), min(len(x), len(y))))
    return out


@pytest.mark.parametrize("hot", [1_000, 3])
def test_near_pairs_of_copies_parts_and_common_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(duplication, "HOT", hot)
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(200)}" for _ in range(n)]
    common, whole = some(30), some(120)
    texts = [("g", i, " ".join(common + some(rng.randrange(5, 80)))) for i in range(40)]
    texts += [("g", 100 + i, " ".join(whole)) for i in range(6)] + [("g", 200 + i, " ".join(whole[i * 9 : i * 9 + 40])) for i in range(8)]
    texts += [("g", 300 + i, " ".join(whole[: rng.randrange(20, 120)] + some(rng.randrange(40)))) for i in range(30)]
    texts += [("h", 400, " ".join(whole)), ("h", 401, "few words"), ("h", 402, "few words"), ("h", 403, ""), ("h", 404, ""), ("h", 405, None), (None, 406, " ".join(whole)), (None, 407, " ".join(whole))]
    df = spark.createDataFrame(texts, "g string, k long, text string")
    found = duplication.near_pairs(duplication.shingle_table(df, "g", "k"), "g", "k")
    assert found.columns == ["g", "a", "b", "shared", "union_size", "least"]
    rows = [tuple(r) for r in found.collect()]
    want = brute_pairs(texts)
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


def test_a_passage_of_all_documents_joins_none(spark):
    """Where a shingle is in every document but isn't among the rare ones of any, no candidate comes from it."""
    rows = [("g", i, "a passage that every document of the group holds " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(3_000)]
    shingles = duplication.shingle_table(spark.createDataFrame(rows, "g string, k long, text string"), "g", "k")
    assert shingles.groupBy("shingle").count().agg(F.max("count")).first()[0] == 3_000
    assert duplication.near_pairs(shingles, "g", "k").count() == 0


def test_audit(spark):
    rows = [(1, "How do I list files?", "Use ls."), (2, "What is a tree?", "A graph without cycles.")]
    ev = [("e1", 0, "how do i list files", "use dir."), ("e2", 1, "How do I list files?", "Use ls."), ("e3", 2, "unlike", "nothing")]
    r, e = spark.createDataFrame(rows, "row_id long, question string, answer string"), spark.createDataFrame(ev, "eval_id string, position int, question string, answer string")
    got = {x.row_id: x for x in leakage.audit(r, e).collect()}
    assert got[1].question_jaccard == 1.0 and got[1].question_jaccard_eval_id == "e1" and got[1].nearest_eval_id == "e2"  # the first of equal maxima
    assert got[1].question_sequence_eval_id == "e2" and [b.eval_id for b in got[1].breaches] == ["e1", "e2"] and not got[1].passed and got[2].passed
    assert got[2].answer_sequence == max(SequenceMatcher(None, "a graph without cycles.", x[3].lower()).ratio() for x in ev)
    related = spark.createDataFrame([(1, ["e1"]), (1, ["e2"])], "row_id long, eval_ids array<string>")
    audited = leakage.audit(r, e, related)
    assert audited.where("passed").count() == 2 and leakage.unchecked(audited).count() == 0
    everything = leakage.audit(r, e, spark.createDataFrame([(1, ["e1", "e2", "e3"])], "row_id long, eval_ids array<string>"))
    assert [(x.rule, x.row_id) for x in leakage.unchecked(everything).collect()] == [("no_independent_evaluation_row", "1")]
    assert [x.row_id for x in everything.where("passed").collect()] == [2] and not everything.where("row_id = 1").first().passed


def test_what_cannot_be_audited_does_not_pass(spark):
    r = spark.createDataFrame([(1, "a question", None), (2, None, "an answer"), (3, "a question", "an answer"), (4, None, None)], "row_id long, question string, answer string")
    kinds = "eval_id string, position int, question string, answer string"
    none = leakage.audit(r, spark.createDataFrame([], kinds))
    assert {(x.row_id, x.checked, x.passed) for x in none.collect()} == {(i, False, False) for i in (1, 2, 3, 4)}
    with pytest.raises(ValueError, match="no_independent_evaluation_row"):
        verify.gate(leakage.unchecked(none))
    some = leakage.audit(r, spark.createDataFrame([("e1", 0, "other words", "unlike")], kinds))
    assert {x.row_id: (x.checked, x.passed) for x in some.collect()} == {1: (False, False), 2: (False, False), 3: (True, True), 4: (False, False)}
    half = leakage.audit(r, spark.createDataFrame([("e1", 0, "other words", None), ("e2", 1, "a question", None)], kinds))
    got = {x.row_id: x for x in half.collect()}
    assert not got[3].checked and got[3].question_jaccard == 1.0 and got[3].answer_jaccard is None and got[3].nearest_eval_id is None
    assert [tuple(b) for b in got[3].breaches] == [("e2", ["question_jaccard", "question_sequence"])]


@pytest.mark.parametrize("part", [5_000, 4])
def test_audit_against_every_pair(spark, monkeypatch, part):
    monkeypatch.setattr(leakage, "PART", part)
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("etaoin shrdlu etaoin .") for _ in range(n))
    ev = [(f"e{i}", i, some(rng.choice([0, 5, 90, 210, 300])), some(rng.choice([30, 199, 200, 400]))) for i in range(14)]
    ev += [("e14", 14, ev[0][2], ev[0][3]), ("e15", 15, None, some(50))]
    rows = [(i, some(rng.choice([0, 30, 150, 260])), some(rng.choice([10, 180, 350]))) for i in range(12)]
    rows += [(20, ev[3][2], ev[4][3][:-9] + "end"), (21, ev[1][2] + " more", ev[2][3]), (22, ev[0][2], ev[0][3])]
    related = {3: ["e1", "e2"], 21: ["e2"], 22: ["e0", "nowhere"]}
    sets = lambda t: set(re.findall(r"\w+", t.lower()))
    like = lambda x, y: len(sets(x) & sets(y)) / len(sets(x) | sets(y)) if sets(x) and sets(y) else 0.0
    ratio = lambda x, y: SequenceMatcher(None, x.lower(), y.lower()).ratio()
    r, e = spark.createDataFrame(rows, "row_id long, question string, answer string"), spark.createDataFrame(ev, "eval_id string, position int, question string, answer string")
    given = spark.createDataFrame(list(related.items()), "row_id long, eval_ids array<string>")
    limits = dict(zip(leakage.METRICS, (0.35, 0.8, 0.35, 0.8)))
    for x in leakage.audit(r, e, given).collect():
        _, q, a = next(y for y in rows if y[0] == x.row_id)
        each = {n: dict(zip(leakage.METRICS, (None if eq is None else like(q, eq), None if eq is None else ratio(q, eq), like(a, ea), ratio(a, ea)))) for n, _, eq, ea in ev}
        own = {n: m for n, m in each.items() if n not in related.get(x.row_id, [])}
        for m in leakage.METRICS:
            best = max(v[m] for v in own.values() if v[m] is not None)
            assert x[m] == best and x[f"{m}_eval_id"] == next(n for n, v in own.items() if v[m] == best)
        assert x.checked and [(b.eval_id, b.metrics) for b in x.breaches] == [(n, got) for n, v in own.items() if (got := [m for m in leakage.METRICS if v[m] is not None and v[m] >= limits[m]])]
        mean = {n: sum(v.values()) / 4 for n, v in each.items() if None not in v.values()}
        assert x.nearest_eval_id == max(mean, key=lambda n: round(mean[n], 12)) and x.passed == (not x.breaches)


_texts = st.text(st.sampled_from("abcdé \U0001f600"), max_size=260) | st.text(st.sampled_from("ab "), min_size=190, max_size=230)


@settings(max_examples=150, deadline=None)
@given(_texts, st.lists(_texts, min_size=1, max_size=3))
def test_ratios_and_their_bounds(text, others):
    index = nearest.Texts([*others, None])
    bound = index.bounds(text)
    assert bound[-1] != bound[-1]
    for i, other in enumerate(others):
        ratio = SequenceMatcher(None, text, other).ratio()
        assert index.ratio(text, i) == ratio <= bound[i]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefghijklmnop"), max_size=30), st.lists(st.none() | st.lists(st.sampled_from("abcdefghijklmnopq"), max_size=30), min_size=1, max_size=9), st.sets(st.integers(0, 8)))
def test_most_alike_sets(tokens, stated, without):
    index, without = nearest.Sets(stated), frozenset(i for i in without if i < len(stated))
    like = [len(set(tokens) & set(s)) / len(set(tokens) | set(s)) if s and tokens else 0.0 for s in stated if s is not None]
    assert [v for v in index.all(tokens) if v == v] == like
    values = {i: len(set(tokens) & set(s)) / len(set(tokens) | set(s)) if s and tokens else 0.0 for i, s in enumerate(stated) if s is not None and i not in without}
    got = index.best(tokens, without)
    assert got == (max(((i, v) for i, v in values.items()), key=lambda x: (x[1], -x[0])) if values else None)


@pytest.mark.parametrize("part", [5_000, 7])
def test_best_sets(spark, monkeypatch, part):
    monkeypatch.setattr(leakage, "PART", part)
    rng = random.Random(4)
    some = lambda n: sorted({f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(n)})
    ev = [(f"e{i}", i, some(rng.randrange(0, 20))) for i in range(40)] + [("none", 40, None)]
    rows = [(i, some(rng.randrange(0, 25)), [f"e{j}" for j in range(0, 40, 3)] if i % 2 else None) for i in range(60)] + [(98, None, None), (99, ["t1"], [f"e{j}" for j in range(40)])]
    got = leakage.best_sets(spark.createDataFrame(rows, "row_id long, tokens array<string>, without array<string>"), spark.createDataFrame(ev, "eval_id string, position int, tokens array<string>"))
    want = {}
    for i, t, without in rows:
        like = [(len({*t} & {*s}) / len({*t} | {*s}) if t and s else 0.0, -p, n) for n, p, s in ev if s is not None and n not in (without or [])] if t is not None else []
        want[i] = (max(like)[2], -max(like)[1], max(like)[0]) if like else (None, None, None)
    assert {x.row_id: (x.eval_id, x.position, x.similarity) for x in got.collect()} == want


def test_similar_pairs_with_a_word_in_every_row(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(["the", *(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))])
    rows = [(i, some(rng.randrange(1, 30)), some(rng.randrange(1, 12)) if i % 5 else "") for i in range(120)]
    ev = [(f"e{i}", some(rng.randrange(1, 30)), some(rng.randrange(1, 12))) for i in range(60)] + [("e60", None, "the")]
    r, e = spark.createDataFrame(rows, "row_id long, question string, answer string"), spark.createDataFrame(ev, "eval_id string, question string, answer string")
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    sets = lambda t: [set((x or "").split()) for x in t[1:]]
    for least in (0.1, 0.35, 0.8):
        want = {(a[0], b[0]) for a in rows for b in ev if max(like(x, y) for x, y in zip(sets(a), sets(b))) >= least}
        got = {(x.row_id, x.eval_id) for x in leakage.token_scores(r, e, least).collect()}
        assert want and got == want


def test_reachability(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    seeds = spark.createDataFrame([("a", 1), ("b", 9), ("b", 9)], "seed string, node long")
    got = crawl.reachable(edges, seeds).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 1, 1), ("b", 2, 2), ("b", 3, 3), ("b", 4, 4), ("b", 9, 0)]
    assert crawl.reachable(edges, seeds.limit(0)).collect() == []


@pytest.mark.parametrize("hops", [1, 3, 8])
@pytest.mark.parametrize("cap", [0, 1, 2, 9, None])
def test_reachability_from_several_start_nodes(spark, monkeypatch, hops, cap):
    """A queue that begins with the start nodes in their order."""
    monkeypatch.setattr(crawl, "HOPS", hops)
    rng = random.Random(8)
    links = {i: [rng.randrange(40) for _ in range(rng.randrange(4))] for i in range(40)} | {100 + i: [101 + i] for i in range(20)}
    starts = {"a": [7, 3, 7, 11], "b": [100, 2], "c": [999]}
    edges = spark.createDataFrame([(i, k, n) for i, to in links.items() for n, k in enumerate(to)] + [(3, None, 9)], "src long, dst long, order int")
    seeds = spark.createDataFrame([(s, n, i) for s, nodes in starts.items() for i, n in enumerate(nodes)] + [("a", None, 0)], "seed string, node long, order int")
    got = {(r.seed, r.node): r.depth for r in crawl.reachable(edges, seeds, cap).collect()}
    want = {}
    for seed, first in starts.items():
        queue = list(dict.fromkeys(first))
        depth = dict.fromkeys(queue, 0)
        for node in queue:
            for k in links.get(node, []):
                if k not in depth:
                    depth[k] = depth[node] + 1
                    queue.append(k)
        want |= {(seed, n): depth[n] for n in queue[:cap]}
    assert got == want


@pytest.mark.parametrize("cap", [1, 7, 40])
def test_reachability_up_to_a_cap(spark, cap):
    """Breadth first with a queue, links in their order."""
    rng = random.Random(cap)
    links = {i: [rng.randrange(60) for _ in range(rng.randrange(5))] for i in range(60)}
    edges = spark.createDataFrame([(i, k, n) for i, to in links.items() for n, k in enumerate(to)], "src long, dst long, order int")
    got = {(r.seed, r.node): r.depth for r in crawl.reachable(edges, spark.createDataFrame([("a", 3), ("b", 5)], "seed string, node long"), cap).collect()}
    want = {}
    for seed, start in (("a", 3), ("b", 5)):
        queue, depth = [start], {start: 0}
        for node in queue:
            for k in links[node]:
                if k not in depth:
                    depth[k] = depth[node] + 1
                    queue.append(k)
        want |= {(seed, n): depth[n] for n in queue[:cap]}
    assert got == want


def test_sources(spark, tmp_path):
    at = f"file://{tmp_path}"
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "a", "question": "é"}\n\n{"id": "b"}\n')
    bad.write_text('{"id": "a"}\n[1]\nnot json\n')
    assert tables.read_jsonl(spark, f"{at}/good.jsonl", "id string, question string").count() == 2
    with pytest.raises(ValueError, match=r"/bad.jsonl:\d+"):
        tables.read_jsonl(spark, f"{at}/bad.jsonl", "id string, question string")
    assert tables.read_jsonl_if_any(spark, f"{at}/none.jsonl", "id string").count() == 0
    assert tables.read_jsonl_if_any(spark, f"{at}/bad.jsonl", "id string").where("id = 'a'").count() == 1
    with pytest.raises(ValueError, match="question"):
        tables.read_jsonl_some(spark, f"{at}/good.jsonl", "id string, question string", ("id", "question"))
    (tmp_path / "keys.jsonl").write_text('{"instruction": "i", "input": "", "output": "o"}\n')
    assert tables.read_jsonl_keys(spark, f"{at}/keys.jsonl", ("instruction", "input", "output"), 1, ("input",)).first().output == "o"
    for keys, n, blank in ((("instruction", "output"), 1, ()), (("instruction", "input", "output"), 2, ()), (("instruction", "input", "output"), 1, ("output",))):
        with pytest.raises(ValueError):
            tables.read_jsonl_keys(spark, f"{at}/keys.jsonl", keys, n, blank)
    (tmp_path / "m.json").write_text(json.dumps({"a": {"b": 1}}, indent=1))
    assert tables.read_json(spark, f"{at}/m.json").select("a.b").first().b == 1


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    df = spark.createDataFrame([("z", "é", None), ("y", "b", 1)], "b string, a string, c int")
    tables.write_jsonl(df, f"{at}/out")
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines) == ['{"a":"b","b":"y","c":1}', '{"a":"é","b":"z","c":null}']
    with pytest.raises(FileExistsError):
        tables.guard(spark, [f"{at}/out"])
    tables.guard(spark, [f"{at}/out"], overwrite=True)
    tables.write_by(df, "b", f"{at}/by")
    assert (tmp_path / "by" / "b=z").is_dir()
    tables.write_manifest(spark.createDataFrame([("train", "u2"), ("test", "u3"), ("train", "u1")], "split string, canonical_url string"), f"{at}/manifest")
    assert [r.canonical_url for p in sorted((tmp_path / "manifest").glob("part-*")) for r in spark.read.csv(f"file://{p}", header=True).collect()] == ["u3", "u1", "u2"]
    tables.write_text(spark, reports.report("T", {"one": df, "two": "text"}), f"{at}/r.md")
    assert (tmp_path / "r.md").read_text().startswith("# T\n\n## one\n\n| b | a | c |\n| --- | --- | ---: |\n") and "| z | é | - |" in (tmp_path / "r.md").read_text()
    tables.write_text(spark, "again", f"{at}/again.md")
    tables.write_text(spark, "and again", f"{at}/again.md")
    assert (tmp_path / "again.md").read_text() == "and again" and not list(tmp_path.glob("again.md.*"))
    assert {r.rule_set for r in tables.rules(spark).collect()} == {"denied_terms", "denied_outputs", "overclaims"}
    (digest,) = tables.file_digests(spark, f"{at}/r.md").collect()
    assert digest.sha256 == hashlib.sha256((tmp_path / "r.md").read_bytes()).hexdigest()
    spark.createDataFrame([([1, 2], [True, False])], "input_ids array<int>, attention_mask array<boolean>").write.parquet(f"{at}/blocks")
    assert tables.read_blocks(spark, f"{at}/blocks", 2).count() == 1
    with pytest.raises(ValueError):
        tables.read_blocks(spark, f"{at}/blocks", 3)


def test_gate(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (2, None)], "id long, v string")
    found = verify.violations(df, "id", {"filled": F.col("v") != ""})
    assert sorted(r.row_id for r in found.collect()) == ["2", "2"]
    with pytest.raises(ValueError, match="filled 2"):
        verify.gate(found)
    verify.gate(verify.missing(df, df, "id", "none"))


def test_contract(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    rows = {r.outcome: r.n for r in e.entry(spark).collect()}
    assert rows == {"short_stub": 43, "exact_content_duplicate": 8, "kept": 149}


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _catalog():
    from loomfield.plans import catalog

    return sorted(catalog.SQL)


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", _catalog())
def test_queries_equal_their_sql(spark, oracle, name):
    from loomfield.plans import catalog

    df = catalog.QUERIES[name](spark, SF)
    cur = oracle.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(_plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr) == want


_long_or_short = st.text(st.sampled_from("ab "), max_size=230) | st.lists(st.sampled_from(["tion ", "the ", "qu", "é", "er", "x", "\U0001f600"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(_long_or_short, st.lists(_long_or_short, min_size=1, max_size=4), st.sampled_from([1 << 20, 40]), st.sampled_from([1 << 16, 20]))
def test_matched_blocks_of_all_stated_texts(text, others, seeds, counted):
    """Blocks placed in all stated texts at once, or one by one where they have too many equal places, give the ratios of every pair."""
    with mock.patch.multiple(nearest, SEEDS=seeds, COUNTED=counted, GROUP=150):
        matched = nearest.Texts([*others, None, ""]).matched(text)
    assert matched.upper[-2] != matched.upper[-2]
    for i, other in enumerate([*others, None, ""]):
        if other is not None:
            assert matched.ratio(i) == SequenceMatcher(None, text, other).ratio() <= matched.upper[i]


def test_few_ratios_are_completed(monkeypatch):
    """Of 120 stated texts of a language, most long, a row's text needs a ratio with few: bounds are near the ratios."""
    rng = random.Random(5)
    some = lambda n: " ".join("".join(rng.choice(["tion", "th", "er", "an", "in", "q", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    stated = [some(rng.randrange(10, 60)) for _ in range(120)]
    sets = [t.split() for t in stated]
    part = leakage.Stated([str(i) for i in range(120)], list(range(120)), stated, stated, (sets, sets))
    done = []
    for kind in (nearest.Texts, getattr(nearest, "Matched", nearest.Texts)):
        monkeypatch.setattr(kind, "ratio", lambda self, *x, ratio=kind.ratio: done.append((id(self), x[-1])) or ratio(self, *x))
    q, a = some(30), some(120)
    got = part.against((q, a), (q.split(), a.split()), None)
    assert got["answer_sequence"]["similarity"] == max(SequenceMatcher(None, a, t).ratio() for t in stated)
    assert len(set(done)) < 120, len(set(done))  # of 240 pairs
