"""Rows by position: numbers over splits, bad lines, parity of stored forms, the last row of a key."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomfield.operators import verify
from loomfield.sources import numbered, tables


@pytest.fixture
def small_splits(spark):
    """Splits of about 200 bytes, some of which share a task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def files_of(folder):
    rng = random.Random(9)
    files = {f"part-{i}.jsonl": [json.dumps({"id": f"{i}-{j}", "n": j}) + " " * rng.randrange(40) if rng.random() < 0.8 else rng.choice(["", "  ", "\t"]) for j in range(n)] for i, n in enumerate([120, 0, 1, 33])}
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + ("\n" if name != "part-3.jsonl" else ""))
    return files


def test_numbers_over_many_splits(spark, tmp_path, small_splits):
    files = files_of(tmp_path)
    want = [(f"{name}", n + 1, line) for name, lines in sorted(files.items()) for n, line in enumerate(lines) if line.strip()]
    every = numbered.numbered_lines(spark, str(tmp_path), blank=True)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted((r.file.rsplit("/", 1)[-1], r.line, r.value) for r in every.collect() if r.value.strip())
    assert got == sorted(want)
    rows = numbered.read_jsonl_numbered(spark, str(tmp_path), "id string, n int").orderBy("position").collect()
    assert [(r.position, r.id, r.n) for r in rows] == [(i, *json.loads(line).values()) for i, (_, _, line) in enumerate(want)]
    own = numbered.numbered_lines(spark, str(tmp_path)).where("file like '%part-3%'").orderBy("line").collect()
    assert [r.line for r in own] == list(range(1, len([x for x in files["part-3.jsonl"] if x.strip()]) + 1))


def test_bad_lines_are_named(spark, tmp_path, small_splits):
    bad = {4: '{"id": "x", "n": ', 60: "[1]", 61: '{"id": "x", "n": "text"}', 90: "5", 91: "{'id': 'x', 'n': 1}", 92: '{"id": "x"} x'}
    lines = [bad.get(i, "" if i % 10 == 1 else json.dumps({"id": str(i), "n": i, "more": None})) for i in range(100)]
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    got = numbered.bad_lines(spark, str(tmp_path), "id string, n int")
    assert {r.line: r.value for r in got.collect()} == {i + 1: t for i, t in bad.items()}
    with pytest.raises(ValueError, match=r"rows.jsonl:5, .*rows.jsonl:61, .*rows.jsonl:62, "):
        tables.read_jsonl(spark, str(tmp_path), "id string, n int")
    with pytest.raises(Exception, match="rows.jsonl, row "):
        numbered.read_jsonl_numbered(spark, str(tmp_path), "id string, n int").collect()
    (tmp_path / "rows.jsonl").write_text("\n".join(x for i, x in enumerate(lines) if i not in bad))
    assert tables.read_jsonl(spark, str(tmp_path), "id string, n int").count() == 100 - len(bad) - 10 + (61 in bad) + (91 in bad)


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("")
    (tmp_path / "blank.jsonl").write_text("\n \n\n")
    assert numbered.read_jsonl_numbered(spark, str(tmp_path), "id string").collect() == []
    assert numbered.bad_lines(spark, str(tmp_path), "id string").collect() == [] and tables.read_jsonl(spark, str(tmp_path), "id string").collect() == []
    assert [r.line for r in numbered.numbered_lines(spark, str(tmp_path), blank=True).orderBy("line").collect()] == [1, 2, 3]


def _forms(spark, rows, chat, items):
    kinds = ("position long, instruction string, output string", "position long, messages array<struct<role:string,content:string>>", "position long, row_index long, instruction_sha256 string, output_sha256 string")
    number = lambda x: [(i, *r) for i, r in enumerate(x)]
    return [spark.createDataFrame(number(x), k) for x, k in zip((rows, chat, items), kinds)]


def _found(spark, *forms):
    return sorted((r.rule, int(r.row_id), r.detail) for r in verify.positional_parity(*_forms(spark, *forms)).collect())


def test_positional_parity(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("q", "a"), ("q", "a"), ("q2", "a2"), ("", "é")]
    chat = [([("user", q), ("assistant", a)],) for q, a in rows]
    items = [(i, sha(q), sha(a)) for i, (q, a) in enumerate(rows)]
    assert _found(spark, rows, chat, items) == []
    assert _found(spark, rows, chat[:3], items) == [("chat_row", 3, "missing")]
    assert _found(spark, rows, chat, [*items, (4, "", "")]) == [("items_row", 4, "extra")]
    shifted = [chat[1], *chat[:-1]]  # equal rows hide the shift until they end
    assert _found(spark, rows, shifted, items) == [("chat_differs", 2, ""), ("chat_differs", 3, "")]
    wrong = [items[0], (9, *items[1][1:]), (2, sha("q"), sha("a2")), (3, None, sha("e"))]
    assert _found(spark, rows, chat, wrong) == [("instruction_hash", 2, ""), ("instruction_hash", 3, ""), ("output_hash", 3, ""), ("row_index", 1, "")]
    odd = [([("assistant", "q"), ("user", "a")],), ([("user", "q")],), (None,), ([("user", ""), ("assistant", "é"), ("user", "")],)]
    assert _found(spark, rows, odd, items) == [("chat_differs", i, "") for i in range(4)]
    made = _forms(spark, rows, chat, items)
    with pytest.raises(ValueError, match="chat rows have id"):
        verify.positional_parity(made[0], made[1].withColumn("id", F.lit(1)), made[2])


def test_last_rows(spark):
    rows = [("a", 0, None), ("b", 1, 1), ("a", 2, 5), (None, 3, 7), ("b", 4, None), ("c", 5, 2)]
    got = numbered.last_rows(spark.createDataFrame(rows, "id string, position long, v int"), "id")
    assert sorted((r.id, r.position, r.v) for r in got.collect()) == [("a", 2, 5), ("b", 4, None), ("c", 5, 2)]
    assert numbered.last_rows(spark.createDataFrame([], "id string, position long"), "id").collect() == []


def test_zipped(spark):
    left, right = spark.createDataFrame([(0, "x"), (1, "y")], "position long, v string"), spark.createDataFrame([(1, None), (2, 3)], "position long, v int")
    got = {r.position: (r.left and r.left.v, r.right and (r.right.v,)) for r in numbered.zipped(left, right).collect()}
    assert got == {0: ("x", None), 1: ("y", (None,)), 2: (None, (3,))}
