"""Order statistics by selection and keyword counts by an automaton, against brute force."""

import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfield.operators import evaluation


@pytest.mark.parametrize(("cuts", "most"), [(1_024, 10_000), (4, 3), (2, 1)])
def test_ranks_by_selection(spark, monkeypatch, cuts, most):
    monkeypatch.setattr(evaluation, "CUTS", cuts)
    monkeypatch.setattr(evaluation, "SORTED", most)
    rng = random.Random(cuts)
    kinds = {"even": lambda: rng.randrange(1000), "few": lambda: rng.randrange(3), "tail": lambda: int(10 ** rng.uniform(0, 17)), "below": lambda: -rng.randrange(5) * 7, None: lambda: rng.randrange(40)}
    rows = [(g, f()) for g, f in kinds.items() for _ in range(rng.choice([59, 60]))] + [("one", 5), ("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    ranks = {"nearest": evaluation.nearest_rank_of(0.95), "floor": evaluation.floor_rank_of(95), "least": lambda n: F.lit(1), "most": lambda n: n, **evaluation.halves_of()}
    got = {r.g: r for r in evaluation.at_ranks(df, "v", ("g",), ranks).select("*", evaluation.middle().alias("median")).collect()}
    assert set(got) == {*kinds, "one"}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert (r.nearest, r.floor, r.least, r.most) == (v[max(0, math.ceil(0.95 * len(v)) - 1)], v[min(len(v) - 1, len(v) * 95 // 100)], v[0], v[-1])
        assert r.median == pytest.approx(statistics.median(v))
    (whole,) = evaluation.at_ranks(df, "v", (), ranks).collect()
    v = sorted(x for _, x in rows if x is not None)
    assert (whole.least, whole.most, whole.floor) == (v[0], v[-1], v[min(len(v) - 1, len(v) * 95 // 100)]) and len(whole) == 6


def test_ranks_of_numbers_that_are_one_as_doubles(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SORTED", 2)
    big = 1 << 60
    df = spark.createDataFrame([(big + i,) for i in range(50)], "v long")
    assert evaluation.at_ranks(df, "v", (), {"x": lambda n: F.lit(20)}).first().x == big + 19


def test_ranks_of_doubles_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SORTED", 4)
    values = [0.1 * i * (-1) ** i for i in range(200)] + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert evaluation.at_ranks(df, "v", (), {"x": lambda n: F.lit(57)}).first().x == sorted(values)[56]
    assert evaluation.at_ranks(df.limit(0), "v", (), {"x": lambda n: n}).collect() == []


def test_timing_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SORTED", 3)
    rows = [("a", float(i)) for i in range(10)] + [("b", 2.5), ("c", None)]
    got = {r.g: tuple(r)[1:] for r in evaluation.timing(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert got == {"a": (10, 4.5, 4.5, 9.0), "b": (1, 2.5, 2.5, 2.5), "c": (0, None, None, None)}


_part = st.text(st.sampled_from("ab é"), min_size=0, max_size=4)


@settings(max_examples=100, deadline=None)
@given(_part)
def test_keywords_that_overlap_themselves(k):
    twice = any((k + k[i:]).count(k) < sum((k + k[i:]).startswith(k, j) for j in range(len(k) + 1)) for i in range(1, len(k)))
    assert evaluation.overlapping(k) or not twice


@pytest.mark.parametrize("chars", [1 << 20, 10])
def test_keyword_counts(spark, monkeypatch, chars):
    monkeypatch.setattr(evaluation, "KEYWORD_CHARS", chars)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("aab é\U0001f600") for _ in range(n))
    texts = [some(rng.randrange(200)) for _ in range(40)] + [None, "", "aaaaaaa", "ababababa"]
    keywords = sorted({some(n) for n in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(3)} | {"aa", "aaa", "aba", "", "nowhere", "a" * 6})
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {k: sum(t.count(k) for t in texts if t is not None) for k in keywords}
    assert {r.k: r.n for r in evaluation.occurrences_in(corpus, keywords).collect()} == want
    items = spark.createDataFrame([(i, keywords[i : i + 3]) for i in range(len(keywords))] + [(99, [])], "id int, keywords array<string>")
    got = {r.id: (r.min_occurrences, r.total_occurrences) for r in evaluation.exposure(items, corpus).collect()}
    assert got == {i: (min(want[k] for k in keywords[i : i + 3]), sum(want[k] for k in keywords[i : i + 3])) for i in range(len(keywords))}
    assert {r.n for r in evaluation.occurrences_in(corpus.limit(0), keywords).collect()} <= {0}
