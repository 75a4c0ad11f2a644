"""Expectations as rows: (rule, row_id, detail). Writers go on only if there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.sources.numbered import zipped


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; rules are conditions that must hold, and null breaks them."""
    each = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))
    return rows.select(F.col(key).cast("string").alias("row_id"), F.explode(each).alias("rule")).select("rule", "row_id", F.lit("").alias("detail"))


def not_unique(rows: DataFrame, column: str, rule: str) -> DataFrame:
    n = rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("row_id"), F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" times")).alias("detail"))


def missing(left: DataFrame, right: DataFrame, key: str, rule: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("row_id"), F.lit("").alias("detail"))


def same_ids(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids that some table lacks, with the names of those."""
    named = [t.select(key).distinct().withColumn("__t", F.lit(n)) for n, t in tables.items()]
    have = reduce(DataFrame.unionByName, named).groupBy(key).agg(F.collect_set("__t").alias("have"))
    lacks = F.array_except(F.array(*map(F.lit, sorted(tables))), "have")
    return have.where(F.size("have") < len(tables)).select(F.lit("id_sets_differ").alias("rule"), F.col(key).cast("string").alias("row_id"), F.array_join(lacks, ",").alias("detail"))


def differing(left: DataFrame, right: DataFrame, key: str, columns: list[str], rule: str) -> DataFrame:
    """Keys whose columns aren't equal in both tables, or that one lacks."""
    l, r = (d.select(F.col(key).alias(f"__{p}"), *(F.col(c).alias(f"__{p}_{c}") for c in columns)) for d, p in ((left, "l"), (right, "r")))
    both = l.join(r, F.col("__l") == F.col("__r"), "full_outer")
    bad = F.array_compact(F.array(*(F.when(~F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")), c) for c in columns)))
    lone = F.col("__l").isNull() | F.col("__r").isNull()
    return both.where(lone | (F.size(bad) > 0)).select(F.lit(rule).alias("rule"), F.coalesce("__l", "__r").cast("string").alias("row_id"), F.when(lone, "missing").otherwise(F.array_join(bad, ",")).alias("detail"))


def positional_parity(rows: DataFrame, chat: DataFrame, items: DataFrame) -> DataFrame:
    """Violations of the stored forms of instruction rows, which are matched by position.

    rows(position, instruction, output); chat(position, messages: array of role and content): the instruction as the user's message and the
    output as the assistant's, and no other column; items(position, row_index, instruction_sha256, output_sha256). row_id is the position.
    A form that lacks a row, or has one that rows lack, is missing or extra there, and not compared.
    """
    if extra := sorted(set(chat.columns) - {"position", "messages"}):
        raise ValueError(f"chat rows have {', '.join(extra)}")
    said = F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"rows.{c}").alias("content")) for role, c in (("user", "instruction"), ("assistant", "output"))))
    messages = F.transform("form.messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    digest = lambda c: F.sha2(F.coalesce(f"rows.{c}", F.lit("")), 256)
    rules = {
        "chat": {"chat_differs": messages.eqNullSafe(said)},
        "items": {"row_index": F.col("form.row_index").cast("long") == F.col("position"), **{f"{c}_hash": F.col(f"form.{c}_sha256") == digest(c) for c in ("instruction", "output")}},
    }
    out = None
    for name, form in (("chat", chat), ("items", items)):
        both = zipped(rows, form, ("rows", "form"))
        there = F.col("rows").isNotNull() & F.col("form").isNotNull()
        broken = [F.when(~there, F.lit(f"{name}_row")), *(F.when(there & ~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules[name].items())]
        detail = F.when(F.col("form").isNull(), "missing").when(F.col("rows").isNull(), "extra").otherwise("")
        got = both.select(F.explode(F.array_compact(F.array(*broken))).alias("rule"), F.col("position").cast("string").alias("row_id"), detail.alias("detail"))
        out = got if out is None else out.unionByName(got)
    return out


def gate(found: DataFrame) -> None:
    """Raises with the first problems if there are any."""
    some = found.limit(20).collect()
    if some:
        raise ValueError("; ".join(f"{r.rule} {r.row_id} {r.detail}".strip() for r in some))
