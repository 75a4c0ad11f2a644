"""Queries of the catalogue over their whole job: all benchmark items and whole texts, against brute force."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomfield.functions import twister
from loomfield.operators import evaluation
from loomfield.plans import catalog


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))


ITEMS = [(i, prose(i, 50)) for i in range(45)]
#: An answer that copies the end of item 44, after its own first 200 characters.
LEAK = prose(100, 45) + " " + ITEMS[44][1][200:]
TURNS = [(1, 0, "user", prose(101, 8)), (1, 1, "assistant", LEAK), (2, 0, "user", ITEMS[43][1]), (2, 1, "assistant", prose(102, 8))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('whole')}"
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def jaccard(a, b):
    a, b = (set(re.findall(r"\w+", x.lower())) for x in (a, b))
    return len(a & b) / len(a | b)


def test_leakage_over_all_items_and_whole_texts(spark, tables):
    got = {(r.row_id, r.eval_id): (r.question_jaccard, r.answer_jaccard) for r in catalog.QUERIES["j5_token_similarity"](spark, tables).collect()}
    rows = {1000: (TURNS[0][3], LEAK), 2000: (TURNS[2][3], TURNS[3][3])}
    want = {(i, f"item{k}"): tuple(jaccard(x, t) for x in rows[i]) for i in rows for k, t in ITEMS}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    similar = {(r.row_id, r.eval_id) for r in catalog.QUERIES["j5_similar_pairs"](spark, tables).collect()}
    assert similar == {k for k, v in want.items() if max(v) >= 0.1} and (1000, "item44") in similar
    firsts = {r.row_id: r.question_jaccard_eval_id for r in catalog.QUERIES["j6_v1_unrelated_maxima"](spark, tables).collect()}
    assert firsts[2000] == "item43"


def test_audit_over_all_items_and_whole_texts(spark, tables):
    got = {r.row_id: r for r in catalog.QUERIES["v1_v2_audit"](spark, tables).collect()}
    assert got[2000].question_sequence_eval_id == "item43" and not got[2000].passed and got[1000].answer_jaccard_eval_id == "item44"
    assert got[1000].answer_sequence == max(SequenceMatcher(None, LEAK, t).ratio() for _, t in ITEMS)


@pytest.mark.parametrize("part", [5_000, 10])
def test_similarity_to_all_items(spark, tables, monkeypatch, part):
    from loomfield.operators import leakage

    monkeypatch.setattr(leakage, "PART", part)
    got = {(r.conv_id, r.turn): r.best for r in catalog.QUERIES["n4_jaccard"](spark, tables).collect()}
    assert got[2, 0] == 1.0 and got == pytest.approx({(c, n): max(jaccard(t, x) for _, x in ITEMS) for c, n, _, t in TURNS})


def test_whole_texts(spark, tables):
    spark.createDataFrame([(1, prose(103, 200) + " then this thing"), (2, "short"), (3, "")], "doc_id long, text string").write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    of = lambda name: {r[0]: r[1:] for r in catalog.QUERIES[name](spark, tables).collect()}
    assert of("n6_code_spans") == {i: (re.findall("`([^`]+)`", t.replace(" th", " `th")),) for i, t in texts.items()} and of("n6_code_spans")[1] != ([],)
    assert of("n15_ordered_distinct") == {i: (list(dict.fromkeys([*re.findall(r"\w+", t), "the", "end"])),) for i, t in texts.items()}
    sizes = {i: [len(w) for w in t.split()] for i, t in texts.items()}
    assert of("k4_labels") == {i: ([n if n > 3 else -100 for n in s], sum(n > 3 for n in s[1:])) for i, s in sizes.items()}


def test_sequence_ratios_of_whole_answers(spark, tables):
    got = {r.id: (r.ratio, r.plain_ratio) for r in catalog.QUERIES["n5_sequence_ratio"](spark, tables).collect()}
    qa = {1000: (TURNS[0][3], LEAK), 2000: (ITEMS[43][1], TURNS[3][3])}
    assert got == {i: tuple(SequenceMatcher(None, *p, autojunk=junk).ratio() for junk in (True, False)) for i, p in qa.items()}


@pytest.mark.parametrize("x", [[3.0], [1.0, -2.0], [float(i % 7 - 3) for i in range(64)], [0.1 * i for i in range(37)], [float(i % 5) for i in range(1000)]])
def test_resamples_are_those_of_pythons_generator(monkeypatch, x):
    monkeypatch.setattr(evaluation, "DRAWS", 1 << 10)
    n, draw = len(x), random.Random(7).randrange
    assert evaluation.resampled_means(x, twister.generator(twister.seeded(7)), 300) == [sum(x[draw(n)] for _ in range(n)) / n for _ in range(300)]


def test_bootstrap_has_all_resamples(spark):
    d = "/root/testdata/sf0.001"
    got = {(r.split, r.comparison, r.judge): (r.ci95_low, r.ci95_high, r.significant) for r in catalog.QUERIES["p5_bootstrap_intervals"](spark, d).collect()}
    groups = {}
    for r in catalog._deltas(spark, d).orderBy("id").collect():
        groups.setdefault((r.split, r.comparison, r.judge), []).append(r.delta)
    assert got.keys() == groups.keys()
    for k in sorted(groups, key=lambda k: len(groups[k]))[:2]:
        x, n, draw = groups[k], len(groups[k]), random.Random(20260815).randrange
        means = sorted(sum(x[draw(n)] for _ in range(n)) / n for _ in range(20_000))
        assert got[k] == (means[500], means[19_500], means[500] > 0 or means[19_500] < 0)


def test_token_counts_by_a_vocabulary(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.token_count for r in catalog.QUERIES["k1_token_ids"](spark, d).collect()} == want


def test_capped_reachability_of_the_query(spark):
    d = "/root/testdata/sf0.001"
    got = catalog.QUERIES["u5_capped"](spark, d).collect()
    whole = {(r.seed, r.node): r.depth for r in catalog.QUERIES["u5_reachable"](spark, d).collect()}
    by = {}
    for r in got:
        assert whole[r.seed, r.node] == r.depth
        by.setdefault(r.seed, []).append(r.depth)
    for seed, depths in by.items():
        every = sorted(v for (s, _), v in whole.items() if s == seed)
        assert sorted(depths) == every[:300]
