"""Near-duplicates among rows that share an id or have none."""

from collections import Counter

import pytest

from loomfield.llm import neardup


def words(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("most", [neardup.MOST_IDS, 0])
def test_keep_one_removes_just_the_rows_judged(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_IDS", most)
    x, y, z = words("x"), words("y"), words("z")
    rows = [(None, x, "a"), (None, y, "a"), (None, None, "a"), (None, "", "a"), (1, x, "b"), (3, z, "b"), (7, z + " more", "b"), (7, words("v"), "b"), (7, None, "c"), (8, words("u"), "c"), (8, words("u"), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __src string")
    got = Counter(map(tuple, neardup.keep_one(docs).collect()))
    assert got == Counter(r for r in rows if r[:2] not in {(None, x), (7, z + " more")})


def test_components_of_shared_ids_and_none(spark):
    from test_selection import components_of

    rows = [(3, words("z")), (7, words("z") + " more"), (7, words("v")), (9, words("v") + " more"), (None, words("y")), (5, words("y") + " more"), (None, words("u")), (None, None)]
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_of(rows)
