"""Stages of the pipeline on rows that share an id or have none."""

import re
from collections import Counter, defaultdict

import numpy as np


from loomfield.llm import mixing, neardup, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def test_every_row_takes_its_own_share(spark):
    rows = [(None if i % 3 == 0 else i % 7, words(f"t{i}_", 1 + i % 11), "abc"[i % 2 :][:1], "mine") for i in range(90)] + [(None, None, "a", "mine"), (None, "", "b", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(3)
    have = defaultdict(int)
    out = mixing.take(docs)
    assert out.columns == docs.columns
    taken = out.collect()
    for r in taken:
        if r.text:
            have[WORD.findall(r.text)[0]] += len(WORD.findall(r.text))
    want = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect() if r["size"])
    assert Counter((i, len(WORD.findall(t)), have[WORD.findall(t)[0]]) for i, t, *_ in rows if t) == want
    assert sum(r.text is None for r in taken) == sum(r.text == "" for r in taken) == 1
    assert Counter(taken) == Counter(mixing.take(docs.repartition(5)).collect())


def test_operators_keep_columns_of_any_name(odd):
    """Helper columns don't meet the input's, which pass unchanged."""
    others = [c for c in odd.columns if c not in ("text", "n_chars")]
    mine = Counter(tuple(r[c] for c in others) for r in odd.collect())
    for out in (secrets.scan(odd, into="found").drop("found"), secrets.redact(odd), neardup.keep_one(odd), mixing.take(odd), toxicity.reject(odd, toxicity.Model(np.empty(0, np.int64), np.empty(0)))):
        assert out.columns == odd.columns
        rows = out.collect()
        assert {tuple(r[c] for c in others) for r in rows} <= set(mine)
    assert Counter(tuple(r[c] for c in others) for r in secrets.redact(odd).collect()) == mine


def test_rows_without_ids_are_spread(spark):
    """Their texts tell their places, so they are in as many buckets as others, and the mix is the same each time."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(None, f"text {i} of this one", "a") for i in range(400)] + [(None, "copy", "a")] * 40 + [(None, None, "a")], "doc_id long, text string, source string")
    keys = docs.select("text", mixing.mix_key(F.col("doc_id"), F.col("text")).alias("key"))
    assert keys.select("key").distinct().count() == 402
    assert keys.select((F.col("key") / 2.0**60).alias("u")).agg(F.min("u"), F.max("u")).first()[1] > 0.9
    first, again = ([tuple(r) for r in mixing.mix(d).collect()] for d in (docs, docs.repartition(7)))
    assert Counter(first) == Counter(again) and sum(r[4] for r in first) == round(1.5 * sum(r[1] for r in first))
