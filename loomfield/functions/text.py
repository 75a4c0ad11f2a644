"""Scalar text functions. Those named exact use vectorised Python, for Unicode forms that Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions.urls import strip

#: Terms that general instruction rows must not hold.
DENIED_TERMS = (
    "claude", "codex", "anthropic", "openai", "chatgpt", "gpt", "coding agent", "worktree", ".claude", "agents.md",
    "mcp", "model context protocol", "teleport", "appserver", "code-review", "security-guidance", "appshots",
    "remote control", "claude-code", "agent sdk",
)
#: Outputs that no instruction row may have.
DENIED_OUTPUTS = {
    "Q&A continuation": r"(?:^|\s)(?:Question|Answer):",
    "destructive rm": r"(?:^|\s)rm\s+-rf(?:\s|$)",
    "destructive reset": r"git\s+reset\s+--hard",
    "destructive clean": r"git\s+clean\s+-[^\s]*f",
    "destructive Docker prune": r"docker\s+system\s+prune",
    "forced kill": r"(?:^|\s)kill\s+-9(?:\s|$)",
    "world-writable chmod": r"chmod\s+777",
}
#: Phrases that claim more than a source says.
OVERCLAIMS = (
    r"\b(?:always|guarantee(?:s|d)?|ensure(?:s|d)?|prevent(?:s|ed)?)\b",
    r"\b(?:securely|security|safe(?:ly)?|data loss|overheat(?:ing)?)\b",
    r"\b(?:without requiring|no special|all future|immediately)\b",
    r"\b(?:unauthori[sz]ed|credential(?:s)?|resource leak(?:s)?|crash(?:ing|es)?)\b",
    r"\b(?:independent copy|returns? one row|successful(?:ly)?)\b",
)


def rounded(c: Column, places: int) -> Column:
    """Rounded half to even on the exact binary value, as Python's round does: 2.675 becomes 2.67."""

    @F.pandas_udf(T.DoubleType())
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, places), na_action="ignore")

    return of(c.cast("double"))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def casefold_all(s: pd.Series) -> pd.Series:
    return s.map(lambda a: [None if t is None else t.casefold() for t in a], na_action="ignore")


def normalise_exact(c: Column) -> Column:
    """NFKC, white space collapsed."""
    return collapse(nfkc(c))


def fold_exact(c: Column) -> Column:
    return casefold(normalise_exact(c))


def alnum(c: Column) -> Column:
    """Runs of a-z and 0-9 of text in lower case, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def alnum_exact(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(casefold(nfkc(c)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def alnum_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def word_tokens(c: Column) -> Column:
    r"""Distinct \w+ of text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / (F.size(a) + F.size(b) - inter))


def _ratio(junk: bool):
    @F.pandas_udf(T.DoubleType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=junk).ratio() for x, y in zip(a, b)], dtype="float64")

    return of


#: Matching-block similarity, with and without the heuristic that ignores frequent characters of long texts.
sequence_ratio, sequence_ratio_plain = _ratio(True), _ratio(False)


def sequence_bound(a: Column, b: Column) -> Column:
    """No sequence ratio of two texts is above this."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)))


def code_spans(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("`([^`]+)`"), F.lit(1))


#: What counts as code, a dot name, and a sentence mark at the end or within; what is taken off generated text.
CODE, DOT_NAME, LAST_MARK, INNER_MARK = "`[^`]*`", r"(?U)(?<!\w)\.[A-Za-z][\w.-]*", r"[.!?]\z", r"[!?]|(?<!\d)\.(?!\d)"
THINKING, LABEL = r"(?is)<think>.*?</think>", r"(?i)^(?:Additional sentence|Answer|Explanation)\s*:\s*"


def many_sentences(c: Column) -> Column:
    """Whether prose outside code spans and dot names has a sentence mark before its last character."""
    prose = F.regexp_replace(F.regexp_replace(c, CODE, ""), DOT_NAME, "")
    return F.regexp_replace(prose, LAST_MARK, "").rlike(INNER_MARK)


def clean_generated(c: Column) -> Column:
    """Without thinking tags, quotes around and a leading label."""
    plain = strip(strip(F.regexp_replace(F.regexp_replace(c, THINKING, ""), r"(?U)\s+", " ")), '"')
    return F.regexp_replace(plain, LABEL, "")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part, from the left."""
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise(F.try_divide(F.length(text) - F.length(F.replace(text, part, F.lit(""))), F.length(part)).cast("int"))


def _bound(of: Callable[..., Column], *values: Column) -> Column:
    """of(*values) with values computed outside of any function that of makes, where vectorised Python may not stand."""
    made = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.element_at(F.transform(F.array(made), lambda s: of(*(s[f"v{i}"] for i in range(len(values))))), 1)


def _trimmed(keyword: Column) -> Column:
    return F.regexp_replace(collapse(keyword), r"""^[`* _.:;()\[\]{}"]+|[`* _.:;()\[\]{}"]+\z""", "")


def evidence_token(keyword: Column) -> Column:
    """A keyword without marks around it, in lower case."""
    return F.lower(_trimmed(keyword))


def excerpt(content: Column, keywords: Column, most: int = 2400, exact: bool = False) -> Column:
    """The part of content around all keywords, or a piece around each if they are far apart; null if one is missing or none is given.

    exact: whether letters are compared by their case folding, in which ß is ss, instead of lower case. Places then count in the folded text.
    """
    whole = collapse(content)
    tokens = F.filter(casefold_all(F.transform(keywords, _trimmed)) if exact else F.transform(keywords, evidence_token), lambda t: t != "")
    folded = casefold(whole) if exact else F.lower(whole)
    at = _bound(lambda t, f: F.transform(t, lambda x: F.struct((F.position(x, f) - 1).alias("a"), F.length(x).alias("n"))), tokens, folded)
    first, last = F.array_min(F.transform(at, lambda p: p["a"])), F.array_max(F.transform(at, lambda p: p["a"] + p["n"]))

    def cut(a, b):
        a = F.greatest(F.lit(0), a)
        return F.substring(whole, a + 1, F.least(F.length(whole), b) - a)

    pieces = F.array_join(F.array_distinct(F.transform(at, lambda p: cut(p["a"] - 140, p["a"] + p["n"] + 180))), " […] ")
    return F.when((F.size(at) > 0) & (first >= 0), F.when(last - first <= most, cut(first - 180, last + 180)).otherwise(pieces))


def holds_all(text: Column, tokens: Column, exact: bool = False) -> Column:
    """Whether text holds all tokens, in whatever case. exact: by case folding instead of lower case."""
    folded, tokens = (casefold(text), casefold_all(tokens)) if exact else (F.lower(text), F.transform(tokens, F.lower))
    return _bound(lambda t, f: F.forall(t, lambda x: F.contains(f, x)), tokens, folded)


#: What a format rule looks for.
END_MARK, LINE_END, NUMBERED = r"[.!?]$", r"[\r\n]", r"(?i)(?:task|pattern|concept)?\s*#\d+"
CONTINUATION, FLAG = "\n|Question:|Answer:", r"(?U)(?<!\w)--[a-zA-Z][\w-]*"


def format_violations(instruction: Column, output: Column) -> Column:
    """Rules that an instruction row breaks, by name."""
    rules = {
        "empty_output": strip(output) == "",
        "too_long": F.length(output) > 100,
        "newline": output.rlike(LINE_END),
        "no_end_mark": ~output.rlike(END_MARK),
        "many_sentences": output.rlike(END_MARK) & many_sentences(output),
        "numbered_placeholder": F.concat_ws(" ", instruction, output).rlike(NUMBERED),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), n) for n, c in rules.items())))


def denied_terms(text: Column, terms=DENIED_TERMS) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))


def matching(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that text matches, in whatever case of letters."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), n) for n, p in patterns.items())))


def addition_violations(addition: Column, original: Column, exact: bool = True) -> Column:
    """Names, in alphabetical order, of the rules that a sentence added to an answer breaks. exact: case is folded; else letters are put in lower case."""
    fold = casefold if exact else F.lower
    spans, given = code_spans(addition), code_spans(original)
    says = lambda pattern: addition.rlike(pattern)
    within = lambda x, y: F.contains(fold(y), fold(x))
    broken = [
        ("combined_length", ~(F.length(original) + 1 + F.length(addition)).between(100, 300)),
        ("continuation", says(CONTINUATION)),
        ("flag", says(FLAG)),
        ("length", ~F.length(addition).between(45, 180)),
        ("new_code", F.size(F.filter(spans, lambda s: F.size(F.filter(given, lambda g: F.contains(g, s))) == 0)) > 0),
        ("no_end_mark", ~says(END_MARK)),
        ("overclaim", says("(?iU)" + "|".join(OVERCLAIMS))),
        ("repeats", within(addition, original) | within(original, addition)),
    ]
    return F.array_compact(F.array(*(F.when(c, n) for n, c in broken)))


def key_and_path(spec: Column) -> Column:
    """KEY=PATH, split at the first = and stripped; without =, both are empty."""
    part = lambda i: strip(F.regexp_extract(spec, "(?s)^([^=]*)=(.*)$", i))
    return F.struct(part(1).alias("key"), part(2).alias("path"))


def keys_and_paths(rows: DataFrame, spec: str) -> DataFrame:
    """rows with key and path of KEY=PATH. Raises if a key or path is empty or a key is there twice."""
    out = rows.withColumn("__x", key_and_path(F.col(spec))).withColumns({"key": F.col("__x")["key"], "path": F.col("__x")["path"]}).drop("__x")
    bad = out.where(F.coalesce((F.col("key") == "") | (F.col("path") == ""), F.lit(True))).select(spec).limit(5).collect()
    if bad:
        raise ValueError(f"no KEY=PATH: {', '.join(repr(r[0]) for r in bad)}")
    twice = out.groupBy("key").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"more than one path for {', '.join(r.key for r in twice)}")
    return out


def merge_distinct(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def stable_fraction(seed: int | Column, value: Column) -> Column:
    """[0, 1) from the first 64 bits of a digest of seed and value."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.substring(F.sha2(F.concat(seed.cast("string"), F.lit("|"), value), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def source_seed(seed: int, name: Column) -> Column:
    """seed shifted by the name's bytes as a little-endian number, modulo 1,000,003."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(name))), lambda i: F.conv(F.hex(F.substring(name.cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    total = F.aggregate(F.reverse(codes), F.lit(0).cast("long"), lambda a, b: (a * 256 + b) % 1_000_003)
    return F.lit(seed) + F.when(F.octet_length(name) > 0, total).otherwise(F.lit(0).cast("long"))
