"""Links, titles and main text of web pages, and reachability over known links."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions import urls
from loomfield.plans.shared import broadcast_if_small, discard, materialize_at, ship

#: A Markdown link to an absolute or root-relative place.
MARKDOWN_LINK = r"\[([^\]]+)\]\((https?://[^)]+|/[^)]+)\)"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def hrefs(html: Column) -> Column:
    """href values of anchors, stripped, without empty, fragment and script ones."""
    found = F.transform(F.arrays_zip(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(HREF), F.lit(2)).alias("b")), lambda x: urls.strip(F.concat(x["a"], x["b"])))
    return F.filter(found, lambda h: (h != "") & ~h.startswith("#") & ~h.startswith("javascript:"))


def root_links(html: Column, base: Column) -> Column:
    """Absolute and root-relative links as normalised URLs."""
    kept = F.filter(hrefs(html), lambda h: h.rlike("(?i)^https?://") | (h.startswith("/") & ~h.startswith("//")))
    return F.transform(kept, lambda h: urls.crawl_url(F.when(h.startswith("/"), F.concat(urls.scheme(base), F.lit("://"), urls.authority(base), h)).otherwise(h)))


def markdown_links(text: Column, base: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(2)), lambda h: urls.strip(h))
    return F.transform(found, lambda h: urls.crawl_url(F.when(h.startswith("/"), F.concat(urls.scheme(base), F.lit("://"), urls.authority(base), h)).otherwise(h)))


#: Character references that stand in attributes of links.
REFERENCES = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def resolved_links(html: Column, base: Column) -> Column:
    """All anchors' links, resolved against base, of any relative form, without fragments."""

    def plain(h: Column) -> Column:
        for said, meant in REFERENCES.items():
            h = F.replace(h, F.lit(said), F.lit(meant))
        return h

    return F.transform(hrefs(html), lambda h: urls.resolve(plain(h), base))


def title(html: Column, url: Column) -> Column:
    """The title, else the first heading, else the last segment of the URL, else the URL."""
    inside = lambda tag: urls.strip(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (inside("title"), inside("h1"), urls.last_segment(url))), url)


_DROPPED = {"script", "style", "nav", "footer", "header"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Text(HTMLParser):
    """Texts by the elements they stand in, without dropped ones."""

    def __init__(self):
        super().__init__()
        self.open: list[str] = []
        self.parts: list[tuple[tuple[str, ...], str]] = []
        self.first: dict[str, int] = {}
        self.ids: list[int] = []
        self.n = 0

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.n += 1
            self.open.append(tag)
            self.ids.append(self.n)
            self.first.setdefault(tag, self.n)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open[-1] != tag:
                self.open.pop()
                self.ids.pop()
            self.open.pop()
            self.ids.pop()

    def handle_data(self, data):
        if data.strip() and not _DROPPED & set(self.open):
            self.parts.append((tuple(self.ids), data.strip()))

    def main(self) -> str:
        for tag in ("main", "article", "body"):
            if tag in self.first:
                return "\n".join(t for ids, t in self.parts if self.first[tag] in ids)
        return "\n".join(t for _, t in self.parts)


def page_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return p.main()


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """Texts of main, else article, else body, without scripts, styles, navigation, footers and headers, one a line."""
    return html.map(page_text)


def extracted(pages: DataFrame) -> DataFrame:
    ship(pages.sparkSession)
    text = pages.select("page_id", "url", title(F.col("html"), F.col("url")).alias("title"), main_text(F.col("html")).alias("content"))
    return text.withColumn("content_length", F.length("content"))


#: Depths that one job goes down; of an unbounded search one only, once so many rows are found at a time.
HOPS, WIDE = 8, 1_000_000
#: So many links at most, of some 30 bytes each, are sent to all tasks.
MOST_LINKS = 500_000


def _hop(state: DataFrame, links: DataFrame, depth: int, cap: int | None) -> DataFrame:
    """state(seed, node, depth, place) with what its nodes of that depth link to, each node where it comes first."""
    step = state.join(links, (F.col("node") == F.col("src")) & (F.col("depth") == depth), "left")
    own = F.struct("node", F.struct("depth", "place", F.lit(None).cast(links.schema["order"].dataType).alias("order"), F.lit(0).alias("new")).alias("at"))
    next_ = F.struct(F.col("dst").alias("node"), F.struct(F.lit(depth + 1).alias("depth"), "place", "order", F.lit(1).alias("new")).alias("at"))
    both = step.select("seed", F.inline(F.array(own, next_))).where("node is not null")
    first = both.groupBy("seed", "node").agg(F.min("at").alias("at"))
    if cap is None:
        return first.select("seed", "node", "at.depth", F.lit(0).cast("long").alias("place"))
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("at", "node"))
    return first.withColumn("nth", nth).where(F.col("nth") <= cap).select("seed", "node", "at.depth", F.col("nth").cast("long").alias("place"))


def reachable(edges: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """(seed, node, depth): what can be reached from each of seeds(seed, node) over edges(src, dst), breadth first.

    cap: the most nodes of a seed, which are those a queue gives first: start nodes by order if seeds has that column, then by node;
    what a node links to by order if edges has that column, then by node. Jobs go down HOPS depths each until no node is found, and each stores what
    it found. With a cap that is a seed's whole queue, cap rows at most, with their places. Without one it is the new nodes only; walks of a
    job may come back over nodes found before, so where they are many a job goes down one depth.

    Cases: repeated seeds and links count once, at their first place; null nodes are none; without seeds or a positive cap there are no rows.
    """
    spark = edges.sparkSession
    order = F.col("order") if "order" in edges.columns else F.col("dst")
    links, drawn = materialize_at(edges.select("src", "dst", order.alias("order")).where("src is not null and dst is not null"), "links")
    links = broadcast_if_small(links, MOST_LINKS)
    first = F.col("order") if "order" in seeds.columns else F.col("node")
    start = seeds.where("node is not null").groupBy("seed", "node").agg(F.min(first).alias("order"), F.lit(0).alias("depth"))
    start = start.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("order", "node")).cast("long") if cap is not None else F.lit(0).cast("long"))
    start = start.where(F.lit(True) if cap is None else F.col("place") <= cap).select("seed", "node", "depth", "place")
    new, at = materialize_at(start, "reach")
    rounds, seen, depth, hops = [at], new, 0, HOPS
    while True:
        state = new if cap is not None else new.where(F.col("depth") == depth)
        for k in range(hops):
            state = _hop(state, links, depth + k, cap)
        depth += hops
        if cap is None:
            state = state.where(F.col("depth") > depth - hops).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        new, at = materialize_at(state, "reach")
        n, deepest = new.agg(F.count("*"), F.max("depth")).first()
        if cap is not None:
            discard(spark, *rounds)
            rounds = []
        rounds.append(at)
        seen = spark.read.schema(new.schema).parquet(*rounds)
        if deepest != depth:
            discard(spark, drawn)
            return seen.select("seed", "node", "depth")
        hops = HOPS if cap is not None or n <= WIDE else 1
