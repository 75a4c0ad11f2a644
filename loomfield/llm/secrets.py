"""Secret scans by a trigram inverted index, in DataFrame functions only.

A Boolean query over trigrams is derived from each rule's regular expression: any text that matches holds all
trigrams of one of its alternatives. The index has a posting (trigram, document) for every trigram that some
rule asks for and every text that holds it, of folded case. Candidates of a rule come from intersecting the
postings of an alternative; only they are verified with the expression. A rule without mandatory trigrams
scans every text.

Cases: a null text is the empty text and has no secrets. Rows with the same or a null document id share their
postings and are verified each by its own text. Texts of any length are scanned whole. An empty table gives no
rows. scan() keeps the other columns of its input, whatever their names, and adds one, named by a parameter, in place of
one of that name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.naming import unused
from loomfield.plans.shared import broadcast_if_small, materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    #: An expression that Java and Python read alike.
    pattern: str
    #: A match counts if this group has so many characters.
    group: int
    least: int = 0


#: The rules of the base scan, in the order of their kinds. A match of access or hex takes in the
#: rest of its run of characters, so a run too short for the least length holds no other match, and the least
#: length can stand in the expression. A short match of assign can hide a later one, so its length is checked after.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"(AKIA[A-Z0-9]{14,})", 1),
    Rule("hex", r"([0-9a-f]{16,})", 1),
)
#: Alternatives that a query keeps apart; an expression with more is cut into shorter strings.
MOST_STRINGS = 64
MOST_CANDIDATES = 2_000_000


def _conjunction(text: str) -> frozenset[str]:
    folded = text.lower()
    return frozenset(folded[i : i + 3] for i in range(len(folded) - 2))


def _least(alternatives: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without alternatives that imply another."""
    return {a for a in alternatives if not any(b < a for b in alternatives)}


class _Deriver:
    """Walks a parsed expression with the set of strings that the part so far, since the last gap, can end in."""

    def __init__(self):
        self.found: set[frozenset[str]] = set()  # of a run that every match holds: the alternatives of its trigrams
        self.open = {""}

    def gap(self) -> None:
        run = _least({_conjunction(s) for s in self.open})
        if frozenset() not in run and (not self.found or len(run) < len(self.found) or min(map(len, run)) > min(map(len, self.found))):
            self.found = run
        self.open = {""}

    def add(self, strings: set[str] | None) -> None:
        if strings is None or len(self.open) * len(strings) > MOST_STRINGS:
            self.gap()
            if strings is None:
                return
        self.open = {a + b for a in self.open for b in strings}

    def walk(self, parsed) -> None:
        for op, arg in parsed:
            name = str(op)
            if name == "SUBPATTERN":
                self.walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and (arg[0], arg[1]) != (1, 1) and arg[0] == 1 and _strings(arg[2]):
                self.add(_strings(arg[2]))
                self.gap()
            else:
                self.add(_strings([(op, arg)]))


def _strings(parsed) -> set[str] | None:
    """All strings that parsed matches if they are few, else None."""
    out = {""}
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            part: set[str] | None = {chr(arg)}
        elif name == "IN":
            part = {chr(v) for o, v in arg if str(o) == "LITERAL"} if all(str(o) == "LITERAL" for o, _ in arg) else None
        elif name == "BRANCH":
            each = [_strings(p) for p in arg[1]]
            part = None if None in each else set().union(*each)
        elif name == "SUBPATTERN":
            part = _strings(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            part = _strings(arg[2])
            part = None if part is None else part | {""}
        else:
            part = None
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams of folded case that a match must hold; empty if the expression needs none."""
    walker = _Deriver()
    walker.walk(re._parser.parse(pattern))
    walker.gap()
    return sorted(walker.found, key=sorted)


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the inverted index, for the trigrams given."""
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))

    def held(whole):  # the folded text, bound once for all trigrams
        return F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(whole, t))

    return docs.select(F.col(key).alias("key"), F.explode(F.element_at(F.transform(F.array(folded), held), 1)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): documents that hold all trigrams of an alternative of a rule's query."""
    spark = index.sparkSession
    terms = [(r.kind, f"{r.kind}/{i}", t, len(a)) for r in rules for i, a in enumerate(trigram_query(r.pattern)) for t in sorted(a)]
    lits = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("alternative"), F.lit(t).alias("trigram"), F.lit(n).alias("needs")) for k, a, t, n in terms))
    wanted = spark.range(1).select(F.inline(lits))
    met = index.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "alternative", "needs").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = needs").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """Matches of a rule in text that count, as array<struct<start, end>> of code points; the end is exclusive."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(whole.alias("m"), checked.alias("g"), F.slice(between, F.lit(1), F.size(whole)).alias("b"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        start = acc["pos"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("pos"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _as_kind(i: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))


def _is_kind(i: int):
    return lambda s: s["kind"] == i


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE, key: str = "doc_id", text: str = "text", into: str = "secret_spans") -> DataFrame:
    """docs with the column into: array<struct<start, kind, end>> by start, then kind in the order of the rules (kind: its number)."""
    needed = sorted({t for r in rules for a in trigram_query(r.pattern) for t in a})
    whole = F.coalesce(F.col(text), F.lit(""))
    of, kinds = unused(docs, "of", "kinds")
    if needed:
        found = materialize(candidates(postings(docs, key, text, needed), rules), "secret-candidates")
        found = found.select(F.col("key").alias(of), F.col("kinds").alias(kinds))
        docs = docs.join(broadcast_if_small(found, MOST_CANDIDATES), docs[key].eqNullSafe(F.col(of)), "left").drop(of)
    else:
        docs = docs.withColumn(kinds, F.array().cast("array<string>"))
    each = []
    for i, rule in enumerate(rules):
        got = F.transform(spans(whole, rule), _as_kind(i))
        if trigram_query(rule.pattern):
            got = F.when(F.array_contains(kinds, rule.kind), got)
        each.append(F.coalesce(got, F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return docs.withColumn(into, F.array_sort(F.concat(*each))).drop(kinds)


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each run of overlapping secrets in text replaced by mark."""
    (into,) = unused(docs, "spans")
    found = scan(docs, rules, key, text, into)
    t = F.col(text)

    def step(acc, s):
        new = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark)).alias("out"))
        over = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], new).otherwise(over)

    clean = F.aggregate(into, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["pos"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size(into) > 0, clean).otherwise(t)).drop(into)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), into="found")
    kinds = F.array(*(F.lit(r.kind) for r in BASE))
    line = F.array_join(F.transform("found", lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    n = [F.size(F.filter("found", _is_kind(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *n, line.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def _sql() -> str:
    q = {i: r.pattern.replace("'", "''") for i, r in enumerate(BASE)}
    lists = ", ".join(f"regexp_extract_all(t, '{q[i]}') AS m{i}, regexp_extract_all(t, '{q[i]}', {r.group}) AS g{i}, string_split_regex(t, '{q[i]}') AS b{i}" for i, r in enumerate(BASE))

    def kind(i: int, r: Rule) -> str:
        return f"""list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: struct_pack(
            s := list_sum(list_transform(b{i}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:i-1], lambda x: length(x))), 0),
            k := {i}, n := length(m{i}[i]), g := length(g{i}[i]))), lambda m: m.g >= {r.least})"""

    parts = ", ".join(f"{kind(i, r)} AS f{i}" for i, r in enumerate(BASE))
    names = "[" + ", ".join(f"'{r.kind}'" for r in BASE) + "]"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT doc_id, {lists} FROM d),
    f AS (SELECT doc_id, {parts} FROM l),
    j AS (SELECT doc_id, {", ".join(f"CAST(len(f{i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))},
          coalesce(array_to_string(list_transform(list_sort(list_concat({", ".join(f"f{i}" for i in range(len(BASE)))})),
              lambda m: {names}[m.k + 1] || ':' || CAST(m.s AS BIGINT) || ':' || CAST(m.s + m.n AS BIGINT)), ','), '') AS spans FROM f)
    SELECT *, sha256(spans) AS base_sha256 FROM j"""


OP1_SQL = _sql()
