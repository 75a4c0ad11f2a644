"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are runs of letters of folded case and, since words are built from stems, their beginnings of PREFIXES bytes.
Training counts in how many toxic and other documents each token occurs, over all labelled documents outside the
held-out fold. Documents are put into groups by minima of hashed 5-word shingles, and each weighs one by the size of
the largest group it is in, so exact and near copies, and texts around one shared passage, count about once together.
The log-odds of a token have an informative Dirichlet prior, the corpus shares of both labels, that weighs SHARE of
all documents and so grows with the corpus; they are shrunk towards 0 by SHRINK deviations. A word scores the log-odds
of the most telling of its tokens, negative ones too, less OFFSET, so clean text scores below 0 on average.

The linear-time scan of Ruzzo and Tompa finds all maximal scoring segments of a text. In clean text the greatest
segment score of n words follows an extreme-value law, P(score <= x) = exp(-K n exp(-lambda x)); lambda and K are
fitted by maximum likelihood to the word scores of labelled clean texts, as they are scanned. A segment is significant
if the law gives it an E-value up to a limit. A text's evidence is minus the logarithm of the sum statistic of its
best segments under that law, turned into a probability by a logistic fit. Both fits use one of CALIBRATION groups,
whose documents aren't counted.

Tokens with shrunken log-odds under LEAST score as 0 and aren't stored: for a higher score a token must occur in a
share of the documents that depends on SHARE, LEAST and the share of toxic labels only, so the vocabulary is bounded
by the mean number of tokens a document over that share, whatever the number of documents. Counts and groups read all
labelled rows; the fits read at most MOST_LABELLED rows of the calibration group, chosen by a hash.

Cases: null and empty texts have no segment and score the probability of no evidence. Texts of any length are
scanned whole. Repeated rows each have a row. Documents without an id are scored and count as not learnt from
by the checksum of the empty text. Without labels of both kinds every text scores the share of toxic labels, or
0. If the calibration group has under FEWEST texts of a kind, all labelled documents are counted and fitted to. An
empty table gives no rows. reject() and passages() keep all columns of their input; a column that passages() is told
to make takes the place of one of that name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import words
from loomfield.llm.labelled import MOST_SENT, bounded, held_out, training_ids, with_texts
from loomfield.plans.shared import broadcast_if_small, materialize, ship

MOST_LABELLED = 50_000
#: Weight of the prior as a share of all documents, and its least weight in documents.
SHARE, LEAST_PRIOR = 0.003, 5.0
#: Deviations that log-odds are shrunk by; least log-odds kept; what every word's score is less than its log-odds.
SHRINK, LEAST, OFFSET = 2.0, 0.1, 0.5
#: Minima of shingles that group copies, words of a shingle, and the weight of a document of its own.
MINIMA, WORDS, UNIT = 3, 5, 1 << 20
#: One of so many groups of copies calibrates; texts of a kind it must have.
CALIBRATION, FEWEST = 5, 5
#: Variance of the prior of log lambda.
RATE_VARIANCE = 0.25
#: Segments with an E-value up to this are passages.
E_VALUE = 0.05
#: Lengths of the beginnings of words that are tokens too, in bytes; only longer words have them.
PREFIXES = (4, 5, 6, 7, 8)
#: Hash bits of the table that tells which tokens may have a score.
SIEVE = 22

#: Token bytes: ASCII letters and all bytes of other characters.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[65:91] = _SEPARATOR[97:123] = False
_SEPARATOR[128:] = False


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters from À to Þ in lower case."""
    out = words.LOWER[buf]
    if len(out) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][latin] += 0x20
    return out


def token_hashes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each word and its beginnings, a row a word; index of each document's first). Where a word is too short, its own hash stands again."""
    low = folded(buf)
    starts, ends, first = words.spans(low, at, _SEPARATOR)
    own = words.word_hashes(low, starts, ends)
    out = np.tile(own[:, None], (1, 1 + len(PREFIXES)))
    for k, n in enumerate(PREFIXES):
        long = np.flatnonzero(ends - starts > n)
        out[long, k + 1] = words.mix(words.word_hashes(low, starts[long], starts[long] + n) ^ np.uint64(n))
    return out.view(np.int64), first


@words.thrifty
def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, t, label, text) with the minima of each text's shingles in place of the text; 0 without words."""
    seeds = words.mix(np.arange(1, MINIMA + 1, dtype=words.U) * words.U(0xD6E8FEB86659FD93))
    for batch in batches:
        for i, buf, at in words.chunks(batch.column(3)):
            low = words.LOWER[buf]
            starts, ends, first = words.spans(low, at)
            h, ptr = words.shingles(words.word_hashes(low, starts, ends), first, WORDS)
            out = np.zeros((len(ptr) - 1, MINIMA), words.U)
            some = np.flatnonzero(np.diff(ptr) > 0)
            for k, seed in enumerate(seeds):
                if len(some):
                    out[some, k] = np.minimum.reduceat(words.mix(h ^ seed), ptr[some])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * MINIMA), pa.array(out.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, len(out)) for c in range(3)), lists], names=["doc_id", "t", "label", "minima"])


@words.thrifty
def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, y1, y0) for each chunk of (text, label, weight): weights of the documents that have a token, by label."""
    for batch in batches:
        label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        for i, buf, at in words.chunks(batch.column(0)):
            h, first = token_hashes(buf, at)
            h, ptr = words.distinct(h.reshape(-1), first * (1 + len(PREFIXES)))
            own, n = slice(i, i + len(ptr) - 1), np.diff(ptr)
            token, where = np.unique(h, return_inverse=True)
            sums = [np.bincount(where, np.repeat(np.where(label[own] == k, weight[own], 0), n), len(token)).astype(np.int64) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(token), *map(pa.array, sums)], names=["token", "y1", "y0"])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), in linear time. Only the places of positive scores are visited."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # [left, right, total before left, total at right, index of the nearest earlier segment with a lesser total before it]
    for i in np.flatnonzero(scores > 0).tolist():
        one = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= one[3]:
                stack.append([*one, j])
                break
            one = [stack[j][0], one[1], stack[j][2], one[3]]
            del stack[j:]
    return [(a, b, float(r - x)) for a, b, x, r, _ in stack]


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    odds: np.ndarray  # their shrunken log-odds
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 1e-9  # K of the law
    slope: float = 0.0
    intercept: float = -30.0
    sieve: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.tokens & ((1 << SIEVE) - 1)] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "sieve"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def score_words(self, h: np.ndarray) -> np.ndarray:
        """The score of each word of token_hashes: the log-odds of largest size among its tokens, less OFFSET."""
        out = np.zeros(len(h))
        if len(self.tokens):
            for k in range(h.shape[1]):
                may = np.flatnonzero(self.sieve[h[:, k] & ((1 << SIEVE) - 1)])
                own = h[may, k]
                at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
                hit = self.tokens[at] == own
                may, odds = may[hit], self.odds[at[hit]]
                out[may] = np.where(abs(odds) > abs(out[may]), odds, out[may])
        return out - OFFSET

    def bits(self, n: int, scores: np.ndarray) -> np.ndarray:
        """Minus the logarithms of the E-values of segments with scores in a text of n words."""
        return self.rate * scores - math.log(self.scale * max(1, n))

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments of one text's word scores, with their E-values."""
        found = segments(scores)
        bits = self.bits(len(scores), np.array([s for _, _, s in found]))
        return [(a, b, math.exp(-x)) for (a, b, _), x in zip(found, bits.tolist()) if x >= -math.log(E_VALUE)]

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(index, word scores, bytes, starts and ends of its words) of each text that has a positive word."""
        for i, buf, at in words.chunks(texts):
            low = folded(buf)
            h, first = token_hashes(buf, at)
            s = self.score_words(h)
            starts, ends, _ = words.spans(low, at, _SEPARATOR)
            for d in np.unique(np.searchsorted(first, np.flatnonzero(s > 0), "right") - 1).tolist():
                own = slice(first[d], first[d + 1])
                yield i + d, s[own], buf[at[d] : at[d + 1]], starts[own] - at[d], ends[own] - at[d]

    def greatest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The greatest segment score, 0 if there is none, and the number of words of each text."""
        out, n = np.zeros(len(texts)), np.ones(len(texts))
        for i, buf, at in words.chunks(texts):
            h, first = token_hashes(buf, at)
            s = self.score_words(h)
            n[i : i + len(at) - 1] = np.maximum(1, np.diff(first))
            for d in np.unique(np.searchsorted(first, np.flatnonzero(s > 0), "right") - 1).tolist():
                out[i + d] = max(x for _, _, x in segments(s[first[d] : first[d + 1]]))
        return out, n

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Evidence of each text, damped."""
        out = np.zeros(len(texts))
        for i, s, *_ in self.texts(texts):
            out[i] = joint(self.bits(len(s), np.array([x for _, _, x in segments(s)])))
        return np.log1p(out)

    def probability(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.evidence(texts), -30, 30)))


def joint(bits: np.ndarray) -> float:
    """Minus the logarithm of the least probability of the sum of the r best segments, exp(-t) t^(r-1) / r! (r-1)!, over all r for which it holds."""
    x = np.sort(bits[bits > 0])[::-1]
    if not len(x):
        return 0.0
    t, r = np.cumsum(x), np.arange(1, len(x) + 1)
    factorials = np.concatenate([[0.0], np.cumsum(np.log(r))])
    value = t - (r - 1) * np.log(t) + factorials[1:] + factorials[:-1]
    return float(max(value[(r == 1) | (t >= r * (r - 1))].max(), 0))


def law(greatest: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(lambda, K) most likely for the greatest segment scores of clean texts of n words; a text without a segment tells that its score is 0 at most.

    For a given lambda the likeliest K is the weight of scored texts over the sum of n exp(-lambda score), so lambda
    is searched for alone, on a grid that is refined once. Scores are log-odds, for which lambda is 1 in theory: its
    logarithm has a normal prior around 0 of variance RATE_VARIANCE, which decides where few texts have a score.
    """
    scored = weight * (greatest > 0)
    if not scored.sum():
        return 1.0, 1 / max(1.0, float((weight * n).sum()))

    def fit(rate):
        k = scored.sum() / (weight * n * np.exp(-rate * greatest)).sum()
        return scored.sum() * (math.log(rate) + math.log(k)) - rate * (scored * greatest).sum() - math.log(rate) ** 2 / (2 * RATE_VARIANCE), k

    grid = np.geomspace(0.02, 50, 120)
    for _ in range(2):
        best = int(np.argmax([fit(r)[0] for r in grid]))
        rate = float(grid[best])
        grid = np.geomspace(grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)], 40)
    return rate, float(fit(rate)[1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """(slope, intercept) of a one-dimensional logistic fit, the slope not negative."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (y - p)) - np.array([ridge, 0]) * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-6])
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def shrunken(y1: Column, y0: Column, n1: float, n0: float) -> Column:
    """The shrunken log-odds of a token that documents of weights y1 and y0 of n1 toxic and n0 others have."""
    prior = max(LEAST_PRIOR, SHARE * (n1 + n0))
    a, b = y1 + F.lit(prior * n1 / (n1 + n0)), y0 + F.lit(prior * n0 / (n1 + n0))
    odds = F.ln(a / b) - F.lit(math.log(n1 / n0))
    return F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - SHRINK * F.sqrt(1 / a + 1 / b))


def weighted(texts: DataFrame) -> DataFrame:
    """(doc_id, t, label, weight, calibrates), stored, of texts(doc_id, t, label, text): a row for each id and text, its weight in units of UNIT."""
    minima = texts.select("doc_id", "t", "label", "text").mapInArrow(_grouped, "doc_id long, t long, label int, minima array<long>")
    rows = materialize(minima.groupBy("doc_id", "t", "label", "minima").agg(F.count("*").alias("copies")), "tox-minima")
    each = rows.select("doc_id", "t", "copies", F.posexplode("minima").alias("k", "minimum"))
    sizes = materialize(each.groupBy("k", "minimum").agg(F.sum("copies").alias("size")).where("size > 1"), "tox-sizes")
    most = each.join(broadcast_if_small(sizes, MOST_SENT), ["k", "minimum"]).groupBy("doc_id", "t").agg(F.max("size").alias("size"))
    calibrates = F.pmod(F.xxhash64(F.element_at("minima", 1)), F.lit(CALIBRATION)) == 0
    found = rows.join(most, ["doc_id", "t"], "left").select("doc_id", "t", "label", calibrates.alias("calibrates"), F.expr(f"greatest(1L, {UNIT}L div coalesce(size, 1L))").alias("weight"))
    return materialize(found, "tox-weights")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    ship(docs.sparkSession)
    none = np.empty(0, np.int64), np.empty(0)
    ids = training_ids(docs, labels, "toxic")
    kinds = {r.label for r in ids.select("label").distinct().collect()}
    if kinds != {0, 1}:
        return Model(*none, intercept=30.0 if kinds == {1} else -30.0)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("t"))
    rows = weighted(with_texts(ids, read, "t"))
    weights = {(r.calibrates, r.label): (r.w / UNIT, r.n) for r in rows.groupBy("calibrates", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    apart = all(weights.get((c, k), (0, 0))[1] >= FEWEST for c in (True, False) for k in (0, 1))
    n1, n0 = (sum(weights.get((c, k), (0, 0))[0] for c in ((False,) if apart else (True, False))) for k in (1, 0))

    def texts_of(some: DataFrame) -> DataFrame:
        return read.join(broadcast_if_small(some.drop("calibrates"), MOST_SENT), ["doc_id", "t"]).select("text", "label", "weight")

    counted = texts_of(rows.where("not calibrates") if apart else rows)
    counts = counted.mapInArrow(_seen, "token long, y1 long, y0 long").groupBy("token").agg(*((F.sum(y) / UNIT).alias(y) for y in ("y1", "y0")))
    kept = counts.select("token", shrunken(F.col("y1"), F.col("y0"), n1, n0).alias("odds")).where(F.abs("odds") >= LEAST).toPandas().sort_values("token")
    model = Model(kept["token"].to_numpy(np.int64), kept["odds"].to_numpy(float))

    fits = materialize(bounded(rows.where("calibrates") if apart else rows, MOST_LABELLED, "toxicity"), "tox-fits")

    @words.thrifty
    def greatest(batches):
        for batch in batches:
            m, n = model.greatest(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(n), batch.column(2)], names=["m", "n", "w"])

    clean = texts_of(fits.where("label = 0")).mapInArrow(greatest, "m double, n double, w long").toPandas()
    model.rate, model.scale = law(*(clean[c].to_numpy(float) / (UNIT if c == "w" else 1) for c in ("m", "n", "w")))

    @words.thrifty
    def evidence(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.evidence(batch.column(0))), batch.column(1), batch.column(2)], names=["x", "y", "w"])

    fit = texts_of(fits).mapInArrow(evidence, "x double, y int, w long").toPandas()
    model.slope, model.intercept = logistic(fit["x"].to_numpy(float), fit["y"].to_numpy(float), fit["w"].to_numpy(float) / UNIT)
    return model


def score(model: Model, text: str = "text") -> Column:
    """The probability that a text is toxic."""

    @words.thrifty
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.probability(texts))

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return scored(batches)

    return of(F.col(text))


def passages(docs: DataFrame, model: Model, text: str = "text", into: str = "toxic_passages") -> DataFrame:
    """docs with the column into: array<struct<start, end, e_value>> of the significant passages by start, in code points, ends exclusive."""

    @F.arrow_udf("array<struct<start:long,end:long,e_value:double>>")
    def of(texts: pa.Array) -> pa.Array:
        out = [[] for _ in range(len(texts))]
        for i, s, own, starts, ends in model.texts(texts):
            before = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # code points before each byte
            out[i] = [{"start": int(before[starts[a]]), "end": int(before[ends[b - 1]]), "e_value": e} for a, b, e in model.passages(s)]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("e_value", pa.float64())])))

    return docs.withColumn(into, of(F.col(text)))


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without those whose score is least or more."""
    return docs.where(score(model) < least)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
