"""Quality by a sparse rule ensemble over text statistics.

Statistics of whole texts are computed in one vectorised pass. Small trees are boosted on the labelled documents
outside the held-out fold; every path from a root becomes a conjunctive rule of at most DEPTH thresholds. A
logistic model with an L1 penalty keeps few of the rules and weighs them. The model is compiled into one Spark
column: a logistic function of a sum of when-expressions over the statistics.

Training reads at most MOST_LABELLED labelled rows, chosen by a hash of their ids.

Cases: null and empty texts have all statistics 0 and a score like others. Texts of any length are measured
whole. Repeated rows each have a row; documents without an id are scored. Without labels of both kinds the score
is the share of label 1, or 0 without labels. An empty table gives no rows. score() reads the text column only
and other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import words
from loomfield.llm.labelled import bounded, held_out, training_ids, with_texts
from loomfield.plans.shared import ship

MOST_LABELLED = 10_000
TREES, DEPTH, RATE, CUTS, LEAST_LEAF = 60, 3, 0.2, 24, 8
#: Part of the training rows that chooses the L1 penalty.
CHOOSING = 0.25

STATISTICS = (
    "words", "mean_word", "distinct_words", "top_word", "distinct_shingles", "upper", "digits", "symbols", "loud",
    "symbol_ends", "stops", "lines", "distinct_lines", "other_bytes", "pipes", "longest_word",
)


def _kind(of: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(of.encode())] = 1
    return out


_UPPER, _LOWER_, _DIGIT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("abcdefghijklmnopqrstuvwxyz"), _kind("0123456789")
_SYMBOL, _STOP, _LOUD, _PIPE = _kind("#$%&*@^~<>{}[]=+_\\/"), _kind(".?"), _kind("!"), _kind("|")
_OTHER = (np.arange(256) >= 128).astype(np.int64)
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _counted(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, greatest number of equal ones) by document."""
    n = len(ptr) - 1
    unique, top = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist())):
        if b > a:
            x = np.sort(h[a:b])
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            unique[i], top[i] = len(edge) - 1, np.diff(edge).max()
    return unique, top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, raw, at in words.chunks(texts):
        n = len(at) - 1
        low = words.LOWER[raw]
        starts, ends, first = words.spans(low, at)
        w = words.word_hashes(low, starts, ends)
        per = np.diff(first).astype(float)
        some, size = np.maximum(per, 1), np.maximum(np.diff(at), 1).astype(float)
        by = lambda kind: words.sums(kind[raw], at) / size
        unique, top = _counted(w, first)
        s, sp = words.shingles(w, first, 5)
        unique5, _ = _counted(s, sp)
        ls, le, lfirst = words.spans(raw, at, _LINE)
        uniquel, _ = _counted(words.word_hashes(raw, ls, le), lfirst)
        length = ends - starts
        longest = np.zeros(n)
        np.maximum.at(longest, np.repeat(np.arange(n), np.diff(first)), length)
        tail = (_SYMBOL[raw[ends - 1]] | _LOUD[raw[ends - 1]]) if len(ends) else np.empty(0, np.int64)
        letters = np.maximum(words.sums((_UPPER + _LOWER_)[raw], at), 1)
        lines = np.diff(lfirst).astype(float)
        out[i : i + n] = np.stack(
            [np.log1p(per), words.sums(length.astype(np.int64), first) / some, unique / some, top / some, unique5 / np.maximum(np.diff(sp), 1), words.sums(_UPPER[raw], at) / letters,
             by(_DIGIT), by(_SYMBOL), by(_LOUD), words.sums(tail, first) / some, words.sums(_STOP[raw], at) / some, lines / some, uniquel / np.maximum(lines, 1), by(_OTHER), by(_PIPE), longest],
            axis=1,
        )
    return out


#: A rule: (statistic, True for above, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[Rule, np.ndarray, float, bool]]:
    """(path, rows, value, whether it's a leaf) of the nodes below the root of a regression tree on gradients."""
    out, todo = [], [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        best = (1e-9, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, at in enumerate(cuts):
                if not len(at):
                    continue
                slot = np.searchsorted(at, x[rows, f], "left")
                left_g, left_h, left_n = (np.cumsum(np.bincount(slot, v, len(at) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                gain[(left_n < LEAST_LEAF) | (len(rows) - left_n < LEAST_LEAF)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, float(at[k])))
        if path:
            out.append((path, rows, float(g[rows].sum() / (h[rows].sum() + 1)), best[1] is None))
        if best[1] is not None:
            f, cut = best[1]
            above = x[rows, f] > cut
            todo += [((*path, (f, True, cut)), rows[above]), ((*path, (f, False, cut)), rows[~above])]
    return out


def _tidy(path: Rule) -> Rule:
    """One bound by statistic and side."""
    bound: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        bound[f, above] = max(bound.get((f, above), cut), cut) if above else min(bound.get((f, above), cut), cut)
    return tuple((f, above, cut) for (f, above), cut in sorted(bound.items()))


def rules_of(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each once."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        for path, rows, value, leaf in _tree(x, cuts, y - p, p * (1 - p)):
            found[_tidy(path)] = None
            if leaf:
                z[rows] += RATE * value
    return list(found)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, k] *= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic model with an L1 penalty; the last is the intercept, which has none."""
    a = np.concatenate([a, np.ones((len(a), 1))], 1)
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    v = np.ones(a.shape[1])
    for _ in range(20):  # the largest eigenvalue
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * len(y) / (np.linalg.norm(a @ v) ** 2 + 1e-9)
    u, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ u, -30, 30)))
        new = u - step * (a.T @ (p - y)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


@dataclass
class Model:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = -30.0

    def compiled(self, stats: Column) -> Column:
        """The score as an expression over a struct of STATISTICS."""
        z = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            parts = [(stats[STATISTICS[f]] > F.lit(cut)) if above else (stats[STATISTICS[f]] <= F.lit(cut)) for f, above, cut in rule]
            condition = parts[0]
            for p in parts[1:]:
                condition = condition & p
            z = z + F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + (holds(self.rules, x) @ np.array(self.weights) if self.rules else 0)
        return 1 / (1 + np.exp(-z)) * np.ones(len(x))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(intercept=30.0 if len(y) and y.max() == 1 else -30.0)
    part = np.random.default_rng(0).random(len(y)) < CHOOSING
    if y[~part].min() == y[~part].max() or not part.any():
        part = np.zeros(len(y), bool)
    rules = rules_of(x[~part], y[~part])
    if not rules:
        return Model(intercept=float(np.log(y.mean() / (1 - y.mean()))))
    a = holds(rules, x)
    best, w = (np.inf, 0.0), None
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        w = lasso(a[~part], y[~part], penalty, w)
        check = part if part.any() else ~part
        p = np.clip(1 / (1 + np.exp(-(a[check] @ w[:-1] + w[-1]))), 1e-6, 1 - 1e-6)
        loss = -float((y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())
        if loss < best[0] * 0.995:
            best = (loss, penalty)
    w = lasso(a, y, best[1], rounds=500)
    keep = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return Model([rules[k] for k in keep], w[keep].tolist(), float(w[-1]))


_STRUCT = ", ".join(f"{n} double" for n in STATISTICS)


def measured(text: str = "text") -> Column:
    """A struct of STATISTICS of a text column."""

    @F.pandas_udf(_STRUCT)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(statistics(pa.array(texts, pa.large_string(), from_pandas=True)), columns=STATISTICS)

    return of(F.col(text))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    ship(docs.sparkSession)
    rows = with_texts(bounded(training_ids(docs, labels, "quality"), MOST_LABELLED, "quality"), docs)
    table = rows.select("doc_id", "label", measured().alias("s")).select("doc_id", "label", "s.*").toPandas().sort_values("doc_id")
    return fit(table[list(STATISTICS)].to_numpy(float), table["label"].to_numpy(float))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), measured().alias("stats"))
    scored = stats.select("doc_id", "held_out", model.compiled(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
