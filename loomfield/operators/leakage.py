"""Similarity of instruction rows to evaluation rows, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text
from loomfield.operators import nearest
from loomfield.plans.shared import materialize, ship, spread

#: A similarity from here on is a breach.
QUESTION_JACCARD, ANSWER_JACCARD, SEQUENCE = 0.35, 0.35, 0.80
METRICS = ("question_jaccard", "question_sequence", "answer_jaccard", "answer_sequence")
#: Evaluation rows are sent to all tasks in parts of about so many bytes of text, and of so many rows at most.
PART_BYTES, PART = 2 << 20, 5_000


def parts(evaluation: DataFrame, key: str = "eval_id", *texts: str) -> list[DataFrame]:
    """evaluation in parts of bounded size, by a hash of its key."""
    size = evaluation.agg(F.count("*").alias("n"), *(F.sum(F.octet_length(F.col(t).cast("string"))).alias(f"b{i}") for i, t in enumerate(texts))).first()
    n = max(1, -(-size.n // PART), *(-(-(size[f"b{i}"] or 0) // PART_BYTES) for i in range(len(texts))))
    return [evaluation.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def token_scores(rows: DataFrame, evaluation: DataFrame, least: float | None = None) -> DataFrame:
    """row_id, eval_id, question_jaccard, answer_jaccard over word sets; pairs below least on both sides are left out where it is given.

    rows(row_id, question, answer), evaluation(eval_id, question, answer). With a least similarity over 0 the pairs come
    from prefix_pairs(); otherwise every stated evaluation row is held against every row, in parts.
    """
    x = rows.select("row_id", text.word_tokens(F.col("question")).alias("q"), text.word_tokens(F.col("answer")).alias("a"))
    y = evaluation.select("eval_id", text.word_tokens(F.col("question")).alias("eq"), text.word_tokens(F.col("answer")).alias("ea"))
    scored = lambda d: d.select("row_id", "eval_id", text.jaccard(F.col("q"), F.col("eq")).alias("question_jaccard"), text.jaccard(F.col("a"), F.col("ea")).alias("answer_jaccard"))
    if least:
        x, y = materialize(x, "leak-rows"), materialize(y, "leak-evaluation")
        pairs = prefix_pairs(x, "row_id", "q", y, "eval_id", "eq", least).union(prefix_pairs(x, "row_id", "a", y, "eval_id", "ea", least)).distinct()
        both = scored(pairs.join(x, "row_id").join(y, "eval_id"))
        return both.where(f"question_jaccard >= {least} or answer_jaccard >= {least}")
    out, x = None, spread(x)
    for part in parts(y):
        got = scored(x.join(F.broadcast(part)))
        out = got if out is None else out.unionByName(got)
    return out


def prefix_pairs(x: DataFrame, a: str, xs: str, y: DataFrame, b: str, ys: str, least: float) -> DataFrame:
    """Distinct (a, b): candidates that hold all pairs of sets xs and ys with a Jaccard similarity of least or more.

    Sets in one order of elements, the rare ones first, that are that alike share one of their first
    size - ceil(least * size) + 1 elements, and differ in size by that factor at most. So only those elements are joined,
    and an element that is in every set is in few prefixes.
    """
    every = x.select(F.explode(xs).alias("w")).unionByName(y.select(F.explode(ys).alias("w")))
    often = materialize(every.groupBy("w").agg(F.count("*").alias("m")), "leak-words")

    def prefixes(d: DataFrame, key: str, c: str, n: str) -> DataFrame:
        each = d.select(key, F.size(c).alias(n), F.explode(c).alias("w")).join(often, "w")
        ordered = each.groupBy(key, n).agg(F.array_sort(F.collect_list(F.struct("m", "w"))).alias("o"))
        kept = F.slice("o", F.lit(1), (F.col(n) - F.ceil(F.col(n) * least - 1e-9) + 1).cast("int"))
        return ordered.select(key, n, F.explode(kept).alias("e")).select(key, n, "e.w")

    left, right = prefixes(x, a, xs, "nx"), prefixes(y, b, ys, "ny")
    return left.join(right, "w").where(f"nx >= {least} * ny - 1e-9 and ny >= {least} * nx - 1e-9").select(a, b).distinct()


def best_sets(rows: DataFrame, evaluation: DataFrame, key: str = "row_id") -> DataFrame:
    """key, eval_id, position, similarity of the evaluation row most alike each row by Jaccard similarity; the earliest of equals, which may share nothing.

    rows(key, tokens, optionally without: eval_ids that don't count), evaluation(eval_id, position, tokens). Each part of the evaluation rows is an inverted
    index in the tasks, so rows aren't joined with them. A row without a token set, or whose evaluation rows are all left out, has nulls.
    Rows of one key are one: the best of any of them.
    """
    ship(rows.sparkSession)
    rows = rows if "without" in rows.columns else rows.withColumn("without", F.lit(None).cast("array<string>"))
    rows, found = spread(rows.select(key, "tokens", "without")), None
    kind = rows.schema[key].dataType.simpleString()
    for part in parts(evaluation.withColumn("joined", F.array_join("tokens", " ")), "eval_id", "joined"):  # a stated set against all rows, in parts of bounded size
        stated = part.select("eval_id", "position", "tokens").orderBy("position", "eval_id").toArrow()
        names, positions = (stated.column(c).to_pylist() for c in ("eval_id", "position"))
        sent = rows.sparkSession.sparkContext.broadcast((names, positions, nearest.Sets(stated.column("tokens").to_pylist())))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, positions, index = sent.value
            place = {n: i for i, n in enumerate(names)}
            for batch in batches:
                out = []
                for tokens, without in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    got = None if tokens is None else index.best(tokens, frozenset(place[n] for n in without or () if n in place))
                    out.append(None if got is None else {"similarity": got[1], "before": -positions[got[0]], "eval_id": names[got[0]]})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _BEST)], names=[key, "best"])

        got = rows.mapInArrow(run, f"`{key}` {kind}, best struct<similarity:double,before:long,eval_id:string>")
        found = got if found is None else found.unionByName(got)
    best = found.groupBy(key).agg(F.max("best").alias("best"))
    return best.select(key, F.col("best.eval_id").alias("eval_id"), (-F.col("best.before")).alias("position"), F.col("best.similarity").alias("similarity"))


_BEST = pa.struct([("similarity", pa.float64()), ("before", pa.int64()), ("eval_id", pa.string())])
_BREACH = pa.list_(pa.struct([("position", pa.int64()), ("eval_id", pa.string()), ("metrics", pa.list_(pa.string()))]))


class Stated:
    """A part of the evaluation rows, by position, with the indexes of both sides."""

    def __init__(self, names: list[str], positions: list[int], questions: list[str | None], answers: list[str | None], sets: tuple[list, list]):
        self.names, self.positions = names, positions
        self.place = {n: i for i, n in enumerate(names)}
        self.sets, self.texts = tuple(map(nearest.Sets, sets)), (nearest.Texts(questions), nearest.Texts(answers))

    def against(self, texts: tuple[str | None, str | None], tokens: tuple[list | None, list | None], without: list[str] | None) -> dict:
        """The best of each metric, the nearest by the mean of all, and the breaches, of one row: ratios are computed only where their bounds leave it open."""
        n = len(self.names)
        exact = [np.full(n, np.nan) if t is None else s.all(t) for s, t in zip(self.sets, tokens)]
        matched = [None if t is None else s.matched(t) for s, t in zip(self.texts, texts)]
        bound = [np.full(n, np.nan) if m is None else m.upper for m in matched]

        def ratio(side: int, i: int) -> float:
            return matched[side].ratio(i)

        def greatest(value, upper: np.ndarray, open_: np.ndarray) -> tuple[int, float] | None:
            """The first place of the greatest value, which upper bounds."""
            best = None
            places = np.flatnonzero(open_ & ~np.isnan(upper))
            for i in places[np.argsort(-upper[places], kind="stable")].tolist():
                if best is not None and upper[i] < best[1]:
                    break
                v = value(i)
                if best is None or v > best[1] or v == best[1] and i < best[0]:
                    best = (i, v)
            return best

        own = np.ones(n, bool)
        own[[self.place[x] for x in without or () if x in self.place]] = False
        out = {}
        for side in (0, 1):
            out[METRICS[2 * side]] = greatest(lambda i: float(exact[side][i]), exact[side], own)
            out[METRICS[2 * side + 1]] = greatest(lambda i: ratio(side, i), bound[side], own)
        mean = lambda q, a: (exact[0] + q + exact[1] + a) / len(METRICS)
        one = lambda i: (exact[0][i] + ratio(0, i) + exact[1][i] + ratio(1, i)) / len(METRICS)
        out["nearest"] = greatest(lambda i: float(one(i)), mean(*bound), np.ones(n, bool))
        out = {k: None if v is None else {"similarity": v[1], "before": -self.positions[v[0]], "eval_id": self.names[v[0]]} for k, v in out.items()}
        over = [(exact[0] >= QUESTION_JACCARD), (bound[0] >= SEQUENCE), (exact[1] >= ANSWER_JACCARD), (bound[1] >= SEQUENCE)]
        out["breaches"] = []
        for i in np.flatnonzero(own & np.any(over, axis=0)).tolist():
            broken = [m for k, m in enumerate(METRICS) if over[k][i] and (k % 2 == 0 or ratio(k // 2, i) >= SEQUENCE)]
            if broken:
                out["breaches"].append({"position": self.positions[i], "eval_id": self.names[i], "metrics": broken})
        return out


def audit(rows: DataFrame, evaluation: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Per row the nearest evaluation row by the mean of METRICS, each metric's greatest value and where, breaches, and whether it passes.

    rows(row_id, question, answer), evaluation(eval_id, position, question, answer), related(row_id, eval_ids), whose pairs are declared and
    don't count but for the nearest. The earliest of equal evaluation rows is named. Each part of the evaluation rows is indexed in the tasks; ratios
    of texts in lower case are computed only for pairs that can still be a greatest one, the nearest or a breach.

    Cases: every row of rows is in the result, rows of one row_id as one. A null text has no metrics of its side. checked tells whether all four metrics
    could be taken from an evaluation row that isn't declared related; a row that can't be checked doesn't pass, so none does where evaluation is empty.
    """
    ship(rows.sparkSession)
    side = lambda d: [F.lower("question").alias("q"), F.lower("answer").alias("a"), text.word_tokens(F.col("question")).alias("qs"), text.word_tokens(F.col("answer")).alias("as")]
    own = rows.select("row_id", *side(rows))
    kind = own.schema["row_id"].dataType.simpleString()
    if related is not None:
        declared = related.groupBy(F.col("row_id").alias("r")).agg(F.flatten(F.collect_list("eval_ids")).alias("without"))
        own = own.join(declared, F.col("row_id") == F.col("r"), "left").drop("r")
    else:
        own = own.withColumn("without", F.lit(None).cast("array<string>"))
    own, found = spread(own), None
    best = (*METRICS, "nearest")
    for part in parts(evaluation, "eval_id", "question", "answer"):  # a stated set against all rows, in parts of bounded size
        stated = part.select("eval_id", F.col("position").cast("long").alias("position"), *side(part)).orderBy("position", "eval_id").toArrow()
        names, positions, questions, answers, qs, as_ = (stated.column(c).to_pylist() for c in ("eval_id", "position", "q", "a", "qs", "as"))
        sent = rows.sparkSession.sparkContext.broadcast(Stated(names, positions, questions, answers, (qs, as_)))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    some = batch.slice(i, 256)
                    got = [sent.value.against((q, a), (qs, as_), w) for q, a, qs, as_, w in zip(*(some.column(c).to_pylist() for c in ("q", "a", "qs", "as", "without")))]
                    columns = [pa.array([g[c] for g in got], _BREACH if c == "breaches" else _BEST) for c in (*best, "breaches")]
                    yield pa.RecordBatch.from_arrays([some.column("row_id"), *columns], names=["row_id", *best, "breaches"])

        schema = ", ".join([f"row_id {kind}", *(f"{c} struct<similarity:double,before:long,eval_id:string>" for c in best), "breaches array<struct<position:long,eval_id:string,metrics:array<string>>>"])
        got = own.mapInArrow(run, schema)
        found = got if found is None else found.unionByName(got)
    merged = found.groupBy("row_id").agg(*(F.max(c).alias(c) for c in best), F.array_distinct(F.array_sort(F.flatten(F.collect_list("breaches")))).alias("breaches"))
    each = [c for m in METRICS for c in (F.col(f"{m}.eval_id").alias(f"{m}_eval_id"), F.col(f"{m}.similarity").alias(m))]
    listed = F.transform("breaches", lambda s: F.struct(s["eval_id"].alias("eval_id"), s["metrics"].alias("metrics"))).alias("breaches")
    checked = reduce(lambda x, y: x & y, (F.col(m).isNotNull() for m in METRICS))
    out = merged.select("row_id", F.col("nearest.eval_id").alias("nearest_eval_id"), *each, listed).withColumn("checked", checked)
    return materialize(out.withColumn("passed", F.col("checked") & (F.size("breaches") == 0)), "leakage")


def unchecked(audited: DataFrame) -> DataFrame:
    """Violations (rule, row_id, detail): rows without a metric, as no evaluation row or text is left to take it from, so that nothing tells whether they leak."""
    return audited.where("not checked").select(F.lit("no_independent_evaluation_row").alias("rule"), F.col("row_id").cast("string").alias("row_id"), F.lit("").alias("detail"))


def exact_matches(rows: DataFrame, evaluation: DataFrame) -> DataFrame:
    """row_id and side where a normalised question or answer equals one of the evaluation rows."""
    out = None
    for side in ("question", "answer"):
        known = evaluation.select(text.alnum(F.col(side)).alias("k")).distinct()
        got = rows.select("row_id", text.alnum(F.col(side)).alias("k")).join(known, "k", "left_semi").select("row_id", F.lit(side).alias("side"))
        out = got if out is None else out.unionByName(got)
    return out


def selection(items: DataFrame, bad_topics: list[str], most: int = 1000) -> DataFrame:
    """items with the first reason that excludes them, or accepted.

    Wants eval_id, position, question, topic, related, overlaps, sources (number of claimed source documents) and
    supported (whether the source holds all keywords and code tokens, and there are keywords). A row that another
    reason excludes still makes later rows with its question duplicates.
    """
    plain = text.collapse(F.col("question"))
    nth = F.row_number().over(Window.partitionBy(F.lower(plain)).orderBy("position"))
    why = (
        F.when(nth > 1, "duplicate_question")
        .when((F.length(plain) > most) | F.coalesce(F.col("topic").isin(bad_topics), F.lit(False)), "malformed")
        .when(F.col("related"), "declared_relation")
        .when(F.col("overlaps"), "similarity_overlap")
        .when(F.col("sources") != 1, "source_count")
        .when(~F.col("supported"), "missing_evidence")
        .otherwise("accepted")
    )
    return items.withColumn("reason", why).withColumn("status", F.when(F.col("reason") == "accepted", "accepted").otherwise("excluded"))


def sources_for(rows: DataFrame, docs: DataFrame, canonical) -> DataFrame:
    """row_id, doc_id, how: documents with exactly the row's source_url, or, for rows without one, with its canonical form."""
    exact = rows.join(docs, rows["source_url"] == docs["url"]).select("row_id", "doc_id", F.lit("exact").alias("how"))
    rest = rows.join(exact.select("row_id").distinct(), "row_id", "left_anti")
    d = docs.select("doc_id", canonical(F.col("url")).alias("__c"))
    return exact.unionByName(rest.join(d, canonical(F.col("source_url")) == F.col("__c")).select("row_id", "doc_id", F.lit("canonical").alias("how")))
