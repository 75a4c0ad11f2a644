"""Language identification by interpolated Kneser-Ney character models, one for each language.

A word is a run of letters and marks in lower case, with ORDER - 1 blanks before and one after it; its characters and the blank after
it are predicted from the ORDER - 1 characters before them. All learning documents are counted, whole: chunks of text are
reduced to their distinct words and those to character n-grams in the tasks, then summed by language. Lower orders count in how many
different places an n-gram continues, as Kneser and Ney do; discounts come from the counts of counts of each language and order. An
n-gram's discounted share and its context's weight for the lower order are column expressions over those tables.

N-grams with a share of less than SHARE of their language's and order's counts are left to the lower orders, whose weight makes up for them. So
a language has at most 1 / SHARE n-grams of an order, whatever the size of the corpus, and at most ORDER / SHARE entries. They reach
the driver and the tasks as sorted arrays of hashes, in parts of about MOST_ENTRIES; more languages take more passes over the texts.

A text's cross-entropy is the mean of its characters' bits, summed in whole 2^-20ths so that no order of summing matters.
The language of the lowest is predicted, the first by code point among equals. One learning text in CALIBRATION, by a hash of
the text, isn't counted but tells how far to trust a prediction: a logistic model sees each of them twice, with its language among the models, and
with that model taken out, where any answer is wrong. It weighs the margin to the next language, the bits that this margin has in all, and
how far the cross-entropy is above that of the language's own texts. Its value is the score; predictions below `least` are marked as rejected.

Cases: null texts and texts without a letter are `und`, with score 0. Languages are compared as strings; null ones aren't learnt
from. A document without an id counts as one with the empty id. Copies count as often as they are there. Texts are read whole. Bytes that aren't
UTF-8 count as no letters. Without any learning text all is `und` with score 0; with one language all texts with a letter get it. An empty
table gives no rows. Columns of the result replace columns of the same names, others are kept.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm import words
from loomfield.llm.labelled import bounded
from loomfield.llm.naming import unused
from loomfield.plans.shared import materialize, ship

ORDER, SHARE, MOST_ENTRIES = 4, 1e-6, 8_000_000
#: One learning text in CALIBRATION calibrates where a language has FEWEST of them; so many texts at most.
CALIBRATION, FEWEST, MOST_CALIBRATING = 10, 20, 20_000
#: Bytes of text whose distinct words are taken together.
CHUNK = 1 << 20
BLANK, UNIT = 0x20, 1 << 20
FOLDS, HELD_OUT = 4, 2
U = np.uint64
_STEP = 0xD6E8FEB86659FD93


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it ends words, whether it is a letter, its lower case, its hash."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter, part = (np.array([k in of for k in kinds]) for of in ("L", "LM"))
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return ~part, letter, lower, words.mix(np.arange(1, 0x110001, dtype=U) * U(_STEP))


def code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each text's begin) of a chunk of UTF-8."""
    try:
        text = raw.tobytes().decode()
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return np.frombuffer(text.encode("utf-32-le"), np.uint32), before[at]
    except UnicodeDecodeError:
        each = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in each])])


@dataclass
class Words:
    """The words of a chunk: code points in lower case, spans, hashes, each text's first word, and its letters."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, at: np.ndarray) -> Words:
        ends_words, letter, lower, value = characters()
        codes, at = code_points(raw, at)
        letters = words.sums(letter[codes].astype(np.int64), at)
        codes = lower[codes]
        starts, ends, first = words.spans(codes, at, ends_words)
        return cls(codes, starts, ends, words.word_hashes(codes, starts, ends, value), first, letters)

    def padded(self, some: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points of some words with blanks around them, places that are predicted, where each word's begin among those)."""
        size = self.ends[some] - self.starts[some]
        begin = np.concatenate([[0], np.cumsum(size + order)])
        ptr = np.concatenate([[0], np.cumsum(size + 1)])
        nth = np.arange(ptr[-1]) - np.repeat(ptr[:-1], size + 1)
        places = np.repeat(begin[:-1], size + 1) + order - 1 + nth
        out = np.full(begin[-1], BLANK, np.uint32)
        inner = nth < np.repeat(size, size + 1)
        out[places[inner]] = self.codes[(np.repeat(self.starts[some], size + 1) + nth)[inner]]
        return out, places, ptr


def gram_hashes(codes: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each place."""
    value = characters()[3]
    out = np.zeros(len(places), U)
    for j in range(n):
        out += value[codes[places - j]] * U(pow(_STEP, j, 1 << 64))
    return out


def counted(order: int):
    """(lang, gram, n) of chunks of (text, lang)."""

    @words.thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            names, of = lang.dictionary, lang.indices.to_numpy()
            for i, raw, at in words.chunks(batch.column("text"), CHUNK):
                w = Words.of(raw, at)
                own = np.repeat(of[i : i + len(at) - 1], np.diff(w.first))
                key = w.hashes ^ words.mix(own.astype(U) + U(1))
                _, some, copies = np.unique(key, return_index=True, return_counts=True)
                codes, places, ptr = w.padded(some, order)
                size = np.diff(ptr)
                spoken = np.repeat(own[some], size)
                h = gram_hashes(codes, places, order) ^ words.mix(spoken.astype(U) + U(1))
                _, one, same = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(same, np.repeat(copies, size), len(one)).astype(np.int64)
                grams = codes[places[one][:, None] + np.arange(1 - order, 1)] if len(one) else np.empty((0, order), np.uint32)
                grams = np.ascontiguousarray(grams).view(f"U{order}").ravel()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(spoken[one])), pa.array(grams.tolist(), pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    return run


def tables(grams: DataFrame, order: int, share: float) -> DataFrame:
    """(lang, gram, kept, left) of all orders, of grams(lang, gram, k) of the highest: the discounted share of a gram in its context, and the context's weight for the lower order."""
    types = grams.select("lang", F.explode(F.expr(f"transform(sequence(2, {order}), n -> right(gram, n))")).alias("gram")).distinct()
    lower = types.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("k"))
    every = grams.unionByName(lower).withColumn("n", F.length("gram"))
    by_order = every.groupBy("lang", "n").agg(F.sum("k").alias("total"), F.count_if(F.col("k") == 1).alias("n1"), F.count_if(F.col("k") == 2).alias("n2"))
    discount = F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))))
    every = every.join(F.broadcast(by_order.select("lang", "n", "total", discount.alias("discount"))), ["lang", "n"])  # as many rows as languages and orders
    context = Window.partitionBy("lang", "n", F.expr("substring(gram, 1, n - 1)"))  # a row for each character at most
    found = every.withColumn("kept", F.when(F.col("k") >= share * F.col("total"), (F.col("k") - F.col("discount")) / F.sum("k").over(context)))
    found = found.withColumn("left", F.greatest(F.lit(1e-9), 1 - F.coalesce(F.sum("kept").over(context), F.lit(0.0))))
    return found.where("kept is not null").select("lang", "gram", "kept", "left")


@dataclass
class Language:
    """Sorted hashes of n-grams and of contexts by order, with what tables() says of each."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, grams: pa.Array, kept: np.ndarray, left: np.ndarray, order: int) -> Language:
        texts = np.array(grams.to_pylist(), dtype=f"U{order}")
        size = np.char.str_len(texts)
        out = cls([], [])
        for n in range(1, order + 1):
            own = np.flatnonzero(size == n)
            codes = np.ascontiguousarray(texts[own].astype(f"U{n}")).view(np.uint32)
            last = np.arange(len(own)) * n + n - 1
            out.grams.append(_sorted(gram_hashes(codes, last, n), kept[own]))
            out.contexts.append(_sorted(gram_hashes(codes, last - 1, n - 1), left[own]))
        return out

    def bits(self, grams: list[np.ndarray], contexts: list[np.ndarray], base: float) -> np.ndarray:
        """-log2 of each place's probability in units of 1 / UNIT, from the hashes of its n-grams and contexts by order."""
        p = np.full(len(grams[0]), base)
        for n in range(len(grams)):
            p = _found(self.grams[n], grams[n], 0.0) + _found(self.contexts[n], contexts[n], 1.0) * p
        return np.rint(-np.log2(p) * UNIT).astype(np.int64)


def _sorted(h: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, one = np.unique(h, return_index=True)
    return h, value[one].astype(np.float32)


def _found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, other: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(h), other)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at].astype(float), other)


def measure(texts: pa.Array, languages: list[Language], order: int, base: float) -> tuple[np.ndarray, np.ndarray]:
    """(predicted characters of each text, 0 without a letter; bits by text and language)."""
    n, bits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(languages)), np.int64)
    for i, raw, at in words.chunks(texts, CHUNK):
        w = Words.of(raw, at)
        _, some, same = np.unique(w.hashes, return_index=True, return_inverse=True)
        codes, places, ptr = w.padded(some, order)
        _, one, again = np.unique(gram_hashes(codes, places, order), return_index=True, return_inverse=True)
        places = places[one]
        grams = [gram_hashes(codes, places, k) for k in range(1, order + 1)]
        contexts = [gram_hashes(codes, places - 1, k) for k in range(order)]
        rows = slice(i, i + len(at) - 1)
        n[rows] = np.where(w.letters > 0, words.sums(w.ends - w.starts + 1, w.first), 0)
        for j, language in enumerate(languages):
            by_word = words.sums(language.bits(grams, contexts, base)[again], ptr)
            bits[rows, j] = words.sums(by_word[same], w.first)
    return n, bits


@dataclass
class Model:
    """Tables of n-grams (lang, gram, kept, left), stored; parts of languages in ascending order; and the calibration."""

    entries: DataFrame | None = None
    parts: list[list[str]] = field(default_factory=list)
    order: int = ORDER
    base: float = 1.0
    typical: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    @property
    def languages(self) -> list[str]:
        return [name for part in self.parts for name in part]

    def load(self, part: list[str]) -> list[Language]:
        out = []
        for name in part:
            rows = self.entries.where(F.col("lang") == name).select("gram", "kept", "left").toArrow()
            out.append(Language.of(rows.column("gram"), *(rows.column(c).to_numpy() for c in ("kept", "left")), self.order))
        return out


def measured(texts: DataFrame, model: Model, text: str, n: str, bits: str) -> DataFrame:
    """texts with the columns n and bits (by language); tables of one part of the languages are sent to the tasks at a time."""
    for k, part in enumerate(model.parts):
        sent, order, base = texts.sparkSession.sparkContext.broadcast(model.load(part)), model.order, model.base

        @words.thrifty
        def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                n, bits = measure(batch, sent.value, order, base)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
                yield pa.StructArray.from_arrays([pa.array(n), flat], ["n", "bits"])

        @F.arrow_udf("struct<n:long,bits:array<long>>")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return measures(batches)

        got = "_".join([bits, "got"])
        texts = texts.withColumn(got, of(F.col(text).cast("string")))
        texts = texts.withColumns({n: F.col(f"`{got}`.n"), bits: F.concat(bits, F.col(f"`{got}`.bits")) if k else F.col(f"`{got}`.bits")}).drop(got)
        if len(model.parts) > 1:
            texts = materialize(texts, "measured")
            sent.destroy()
    return texts


def evidence(bits: np.ndarray, n: np.ndarray, own: np.ndarray, typical: np.ndarray, base: float) -> np.ndarray:
    """What calibration sees of cross-entropies by text and language, for the language own: margin, logarithm of its bits, excess, and 1."""
    rows = np.arange(len(own))
    h = bits[rows, own]
    rest = bits.copy()
    rest[rows, own] = np.inf
    margin = np.minimum(rest.min(axis=1), -math.log2(base)) - h
    return np.stack([margin, np.log1p(np.maximum(margin, 0) * n), np.maximum(h - typical[own], 0), np.ones(len(n))], 1)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model, its last column not shrunken."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w


def calibrate(model: Model, texts: DataFrame) -> None:
    """Sets what the model knows of texts(text, lang) whose language is one of its own."""
    found = measured(texts, model, "text", "n", "bits").where("n > 0").select("lang", "n", "bits").toArrow()
    names = model.languages
    place = {name: i for i, name in enumerate(names)}
    n = found.column("n").to_numpy()
    own = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    every = np.array(found.column("bits").to_pylist(), float).reshape(len(n), len(names)) / (np.maximum(n, 1) * UNIT)[:, None]
    h = every[np.arange(len(n)), own]
    model.typical = [float(h[own == i].mean()) if (own == i).any() else -math.log2(model.base) for i in range(len(names))]
    typical, x, y = np.array(model.typical), [], []
    best = every.argmin(axis=1)
    x.append(evidence(every, n, best, typical, model.base))
    y.append((best == own).astype(float))
    if len(names) > 1:
        without = every.copy()
        without[np.arange(len(n)), own] = np.inf
        x.append(evidence(without, n, without.argmin(axis=1), typical, model.base))
        y.append(np.zeros(len(n)))
    order = np.lexsort(np.concatenate(x).T)
    model.weights = fitted(np.concatenate(x)[order], np.concatenate(y)[order]).tolist()


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", order: int = ORDER, share: float = SHARE) -> Model:
    """A model of the languages of those docs for which learn holds and whose lang isn't null."""
    ship(docs.sparkSession)
    own = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    has = own.groupBy("lang").agg(F.count("*").alias("n"))
    apart = sorted(r.lang for r in has.where(F.col("n") >= FEWEST).collect())  # as many rows as languages
    kept_back = F.col("lang").isin(apart) & (F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0)
    grams = own.where(~kept_back).mapInArrow(counted(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("k"))
    entries = materialize(tables(materialize(grams, "lang-grams"), order, share), "lang-model")
    sizes = {r.lang: r.n for r in entries.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    model, room = Model(entries, order=order), 0
    for name in sorted(sizes):
        if sizes[name] > room:
            model.parts.append([])
            room = max(MOST_ENTRIES, sizes[name])
        model.parts[-1].append(name)
        room -= sizes[name]
    model.base = 1 / (1 + entries.where(F.length("gram") == 1).select("gram").distinct().count())
    known = own.where(F.col("lang").isin(list(sizes)))
    texts = known.where(kept_back) if apart else known
    ids = bounded(texts.select(F.xxhash64("text").alias("doc_id")).distinct(), MOST_CALIBRATING, "language")
    if sizes:
        few = texts.withColumn("doc_id", F.xxhash64("text")).dropDuplicates(["doc_id", "lang"]).join(F.broadcast(ids), "doc_id", "left_semi")
        calibrate(model, few.select("text", "lang"))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with lang_pred, score, cross_entropy (bits a character) and accepted."""
    made = {"lang_pred": "und", "score": 0.0, "cross_entropy": None, "accepted": False}
    names = model.languages
    if not names:
        return docs.withColumns({c: F.lit(v).cast("double") if c == "cross_entropy" else F.lit(v) for c, v in made.items()})
    n, bits, h, first, rest = unused(docs.select("*", *(F.lit(0).alias(m) for m in made)), "n", "bits", "h", "first", "rest")
    out = measured(docs, model, text, n, bits)
    out = out.withColumn(h, F.transform(bits, lambda b: b / (F.greatest(F.col(n), F.lit(1)) * float(UNIT))))
    out = out.withColumn(first, F.array_position(h, F.array_min(h)).cast("int"))
    typical, every = F.array(*map(F.lit, model.typical)), F.array(*map(F.lit, names))
    best = F.array_min(h)
    others = F.array_min(F.concat(F.slice(h, 1, F.col(first) - 1), F.slice(h, F.col(first) + 1, len(names)), F.array(F.lit(-math.log2(model.base)))))
    out = out.withColumn(rest, others - best)
    a, b, c, d = model.weights
    z = a * F.col(rest) + b * F.log1p(F.greatest(F.col(rest), F.lit(0.0)) * F.col(n)) + c * F.greatest(best - F.element_at(typical, F.col(first)), F.lit(0.0)) + d
    some = F.col(n) > 0
    out = out.withColumns({"lang_pred": F.when(some, F.element_at(every, F.col(first))).otherwise("und"), "score": F.when(some, 1 / (1 + F.exp(-z))).otherwise(0.0), "cross_entropy": F.when(some, best)})
    return out.withColumn("accepted", some & (F.col("score") >= least)).drop(n, bits, h, first, rest)


def held_out(doc_id: Column) -> Column:
    """Whether a document's lang isn't learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out(F.col("doc_id")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
