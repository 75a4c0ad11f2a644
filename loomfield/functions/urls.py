"""URL functions. The canonical forms differ on purpose: each has its own users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query of a URL; any part may be missing.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
#: Extensions of files that are no documents.
ASSETS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "css", "js", "woff", "woff2", "ttf", "eot", "pdf", "zip")
#: Names of files that hold many documents.
AGGREGATES = ("llms.txt", "llms-full.txt", "codex-manual.md")
#: What tells a URL's part of the corpus, the first that occurs, and the name of the rest.
CATEGORIES, OTHER = (("claude.com", "claude_code"), ("/api/docs/", "openai_platform_api")), "codex_cli"


def strip(c: Column, chars: str = r"\s") -> Column:
    """Without white space (or chars) at both ends, that of Unicode too."""
    return F.regexp_replace(c, rf"(?U)^[{chars}]+|[{chars}]+\z", "")


def part(url: Column, n: int) -> Column:
    """Part n of PARTS, without blanks before the URL and tabs and line ends within."""
    return F.regexp_extract(F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", ""), PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    return F.regexp_replace(part(url, 3), r";[^/]*\z", "")


def crawl_url(url: Column) -> Column:
    """Without fragment and one slash at the end of a path longer than that; the query stays."""
    p = F.regexp_replace(path(url), r"(.)/\z", "$1")
    query = part(url, 4)
    return F.concat(scheme(url), F.lit("://"), authority(url), p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def without_dots(p: Column, keep: Column) -> Column:
    """A path that begins with a slash without . and .. segments, which take the one before away. Empty segments within stay where keep holds; after a last . or .. comes a slash."""
    segments = F.split(p, "/")
    last = F.element_at(segments, -1)
    inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))

    def add(before: Column, x: Column) -> Column:
        return F.when(x == ".", before).when(x == "..", F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0)))).otherwise(F.concat(before, F.array(x)))

    whole = F.aggregate(F.concat(F.filter(inner, lambda x: keep | (x != "")), F.array(last)), F.array(F.lit("")), add)
    joined = F.array_join(F.concat(whole, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(ref: Column, base: Column) -> Column:
    """What a reference on the page base names, without fragment: a whole URL, or one relative to base by scheme, host, path or query.

    An empty or null base leaves a reference as it is. Parameters belong to their segment.
    """
    asks = lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")
    plain = F.regexp_replace(ref, r"(?s)#.*\z", "")
    names = ("scheme", "host", "path", "query")
    both = F.struct(plain.alias("ref"), *(part(plain, i + 1).alias(n) for i, n in enumerate(names)), *(part(base, i + 1).alias(f"base_{n}") for i, n in enumerate(names)))

    def named(x: Column) -> Column:  # x: the parts, found once
        own = F.lower(x["base_scheme"])
        here = F.concat(own, F.lit("://"), x["base_host"])
        merged = F.when(x["path"].startswith("/"), x["path"]).otherwise(F.concat(F.when(x["base_path"] == "", "/").otherwise(F.regexp_replace(x["base_path"], r"[^/]*\z", "")), x["path"]))
        return (
            F.when((F.coalesce(base, F.lit("")) == "") | (x["scheme"] != "") & (F.lower(x["scheme"]) != own), x["ref"])
            .when(x["host"] != "", F.concat(own, F.lit("://"), x["host"], x["path"], asks(x["query"])))
            .when(x["path"] == "", F.concat(here, x["base_path"], asks(F.when(x["query"] != "", x["query"]).otherwise(x["base_query"]))))
            .otherwise(F.concat(here, without_dots(merged, x["path"].startswith("/")), asks(x["query"])))
        )

    return F.element_at(F.transform(F.array(both), named), 1)


def is_allowed(url: Column, hosts: list[str], prefixes: list[str]) -> Column:
    """http or https, one of the hosts exactly, no asset, and a path with one of the prefixes."""
    prefixed = F.lit(False)
    for p in prefixes:
        prefixed = prefixed | path(url).startswith(p)
    asset = F.lower(path(url)).rlike(r"\.(" + "|".join(ASSETS) + r")\z")
    return scheme(url).isin("http", "https") & authority(url).isin(hosts) & ~asset & prefixed


def canonical_document(url: Column) -> Column:
    """For the corpus: no query or fragment, a .md suffix dropped before all slashes at the end, host in lower case."""
    u = strip(url)
    p = F.regexp_replace(F.regexp_replace(part(u, 3), r"(?i)\.md\z", ""), r"/+\z", "")
    return F.concat(scheme(u), F.lit("://"), F.lower(authority(u)), F.when(p == "", "/").otherwise(p))


def canonical_source(url: Column) -> Column:
    """For provenance of instruction rows: slashes at the end dropped before one .md suffix."""
    return F.regexp_replace(F.regexp_replace(strip(url), r"/+\z", ""), r"\.md\z", "")


def canonical_analysis(url: Column) -> Column:
    """For analysis: every .md is dropped."""
    return F.replace(F.regexp_replace(url, r"/+\z", ""), F.lit(".md"), F.lit(""))


def is_markdown(url: Column) -> Column:
    return F.lower(part(url, 3)).endswith(".md")


def is_aggregate(url: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(part(url, 3), r"/+\z", ""), "/"), -1)).isin(*AGGREGATES)


def category(url: Column, rules=CATEGORIES, other: str = OTHER) -> Column:
    out = F.lit(other)
    for text, name in reversed(rules):
        out = F.when(F.contains(url, F.lit(text)), name).otherwise(out)
    return out


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def display_title(title: Column, url: Column) -> Column:
    """The title if it is one line of 1 to 200 characters, else the last segment of the URL, else the URL."""
    fits = (F.length(title) > 0) & (F.length(title) <= 200) & ~F.contains(title, F.lit("\n"))
    segment = last_segment(F.regexp_replace(url, r"/+\z", ""))
    return F.when(F.coalesce(fits, F.lit(False)), title).when(segment != "", segment).otherwise(url)
