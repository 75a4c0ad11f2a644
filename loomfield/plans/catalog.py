
from __future__ import annotations

import json
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions import text, urls
from loomfield.operators import blocks, clean, crawl, duplication, evaluation, leakage, split, verify
from loomfield.plans import derived, reports
from loomfield.plans.derived import ANSWERS, CORPUS, JUDGES, MODELS, QA, RAW, SCORES, table, with_
from loomfield.plans.shared import new_path, spread
from loomfield.sources import numbered, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LEAST = 800


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _part(n: int, url: str = "url") -> str:
    return f"regexp_extract({url}, '{urls.PARTS}', {n})"


_CANONICAL = lambda u: f"""lower({_part(1, u)}) || '://' || lower({_part(2, u)}) || CASE WHEN regexp_replace(regexp_replace({_part(3, u)}, '(?i)\\.md$', ''), '/+$', '') = '' THEN '/'
  ELSE regexp_replace(regexp_replace({_part(3, u)}, '(?i)\\.md$', ''), '/+$', '') END"""  # noqa: E731
_PATH = lambda u: f"regexp_replace({_part(3, u)}, ';[^/]*$', '')"
_CRAWL = lambda u: f"""lower({_part(1, u)}) || '://' || {_part(2, u)} || regexp_replace({_PATH(u)}, '(.)/$', '\\1') || CASE WHEN {_part(4, u)} <> '' THEN '?' || {_part(4, u)} ELSE '' END"""
_COLLAPSE = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_FRACTION = lambda v: f"CAST(CAST('0x' || substr(sha256({v}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE"


# Sources, sinks, digests: written to the shared folder and read back

_DOCS = "doc_id long, lang string, source string, text string"


def _lines(spark, d):
    """Documents as JSON lines; the folder that holds them."""
    at = new_path(spark, "lines")
    tables.write_jsonl(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), at)
    return at


@query("SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents")
def s1_s8_json_lines(spark, d):
    return tables.read_jsonl(spark, _lines(spark, d), _DOCS).select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


def _ordered_lines(df, by, tag):
    """Lines of text(by, value) over several files in the order of by, with a blank line after every tenth; the folder that holds them."""
    at = new_path(df.sparkSession, tag)
    each = df.select(by, F.inline(F.array(F.struct(F.lit(0).alias("k"), "value"), F.struct(F.lit(1).alias("k"), F.when(F.col(by) % 10 == 0, " ").alias("value"))))).where("value is not null")
    each.repartitionByRange(4, by).sortWithinPartitions(by, "k").select("value").write.text(at)
    return at


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, sha256(text) AS text_sha256 FROM documents")
def s1_numbered_json_lines(spark, d):
    """Documents as JSON lines, with the positions of rows over all files; blank lines don't count."""
    rows = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    return numbered.read_jsonl_numbered(spark, _ordered_lines(rows, "doc_id", "numbered"), "doc_id long, text string").select("position", "doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH x AS (SELECT doc_id, doc_id + 1 + CASE WHEN doc_id = 0 THEN 0 ELSE (doc_id + 9) // 10 END AS line FROM documents) SELECT doc_id, CAST(line AS BIGINT) AS line FROM x WHERE doc_id % 37 = 5""")
def s1_bad_lines(spark, d):
    """The lines of one file that are no objects: every 37th is cut short. Blank lines count."""
    text_ = F.to_json(F.struct("doc_id", F.substring("text", 1, 40).alias("text")))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 37 == 5, F.expr("substring(to_json(struct(doc_id, lang)), 1, length(to_json(struct(doc_id, lang))) - 2)")).otherwise(text_).alias("value"))
    at = new_path(spark, "bad-lines")
    each = rows.select("doc_id", F.inline(F.array(F.struct(F.lit(0).alias("k"), "value"), F.struct(F.lit(1).alias("k"), F.when(F.col("doc_id") % 10 == 0, " ").alias("value"))))).where("value is not null")
    each.repartition(1).sortWithinPartitions("doc_id", "k").select("value").write.text(at)
    bad = numbered.bad_lines(spark, at, "doc_id long, text string")
    return bad.select(F.regexp_extract("value", '"doc_id":([0-9]+)', 1).cast("long").alias("doc_id"), "line")


@query("SELECT doc_id, lang FROM documents")
def s2_permissive_json_lines(spark, d):
    """Documents, and nothing from a folder that isn't there."""
    there, absent = (tables.read_jsonl_if_any(spark, at, _DOCS) for at in (_lines(spark, d), new_path(spark, "absent")))
    return there.unionByName(absent).select("doc_id", "lang")


@query("SELECT doc_id, source, length(text) AS n FROM documents")
def s3_s4_required_fields(spark, d):
    return tables.read_jsonl_some(spark, _lines(spark, d), _DOCS, ("doc_id", "source", "text")).select("doc_id", "source", F.length("text").cast("long").alias("n"))


@query("SELECT CAST(item_id AS VARCHAR) AS instruction, '' AS input, text AS output FROM benchmark")
def s5_exact_keys(spark, d):
    b, at = table(spark, d, "benchmark"), new_path(spark, "keys")
    tables.write_jsonl(b.select(F.col("item_id").cast("string").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output")), at)
    return tables.read_jsonl_keys(spark, at, ("instruction", "input", "output"), b.count(), ("input",))


@query("SELECT n_nationkey AS key, n_name AS name, 'nations' AS kind FROM nation")
def s6_json_document(spark, d):
    """One nested document over several lines."""
    rows = [r.asDict() for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()]  # a table of fixed size
    at = new_path(spark, "config") + ".json"
    tables.write_text(spark, json.dumps({"kind": "nations", "rows": rows}, indent=1), at)
    return tables.read_json(spark, at).select("kind", F.explode("rows").alias("r")).select(F.col("r.n_nationkey").cast("int").alias("key"), F.col("r.n_name").alias("name"), "kind")


@query("SELECT item_id, CASE WHEN len(w) < 16 THEN len(w) ELSE 16 END AS used FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)")
def s7_stored_blocks(spark, d):
    """Blocks of 16 places, one for the first words of each item, stored and scanned."""
    at, n = new_path(spark, "blocks"), F.least(F.size("w"), F.lit(16))
    b = table(spark, d, "benchmark").withColumn("w", F.transform(blocks.words(F.col("text")), F.length))
    ids, mask = (F.concat(F.slice(x, F.lit(1), n), F.array_repeat(F.lit(pad), 16 - n)) for x, pad in ((F.col("w"), 0), (F.transform("w", lambda _: F.lit(True)), False)))
    b.select("item_id", ids.alias("input_ids"), mask.alias("attention_mask")).write.parquet(at)
    return tables.read_blocks(spark, at, 16).select("item_id", F.size(F.filter("attention_mask", lambda m: m)).cast("long").alias("used"))


@query("SELECT 'whole' AS state, 2 AS lines, sha256('two' || chr(10) || 'lines') AS text_sha256")
def s9_replaced_text(spark, d):
    """A text file that is written and then replaced by a longer one, and its digest from the file."""
    at = new_path(spark, "text") + ".txt"
    for t in ("one", "two\nlines"):
        tables.write_text(spark, t, at)
    digest = tables.file_digests(spark, at).select("sha256")
    return spark.read.text(at).agg(F.count("*").cast("int").alias("lines")).join(digest).select(F.lit("whole").alias("state"), "lines", F.col("sha256").alias("text_sha256"))


@query(with_(CORPUS) + " SELECT CASE WHEN doc_id % 4 = 1 THEN 'test' ELSE 'train' END AS split, canonical_url, CAST(token_count AS VARCHAR) AS token_count FROM corpus")
def s10_manifest(spark, d):
    at = new_path(spark, "manifest")
    tables.write_manifest(_half(spark, d).select("split", "canonical_url", "token_count"), at)
    return spark.read.csv(at, header=True)


@query("SELECT unnest(['refused', 'replaced']) AS outcome, unnest([1, 2]) AS rows")
def s11_guarded_output(spark, d):
    """An output that is there is refused, and replaced only where that is asked for."""
    at = new_path(spark, "guarded")
    tables.write_jsonl(spark.range(1), at)
    try:
        tables.guard(spark, [at])
        first = "written"
    except FileExistsError:
        first = "refused"
    before = spark.read.json(at).count()
    tables.guard(spark, [at], overwrite=True)
    tables.write_jsonl(spark.range(2), at, overwrite=True)
    return tables.literal(spark, [(first, before), ("replaced", spark.read.json(at).count())], "outcome string, rows int")


@query("""SELECT unnest(['# Nations', '', '## Rows', '', '| n_name | n_regionkey |', '| --- | ---: |']) AS value UNION ALL SELECT '| ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' FROM nation""")
def s13_report(spark, d):
    at = new_path(spark, "report") + ".md"
    tables.write_text(spark, reports.report("Nations", {"Rows": table(spark, d, "nation").select("n_name", "n_regionkey")}), at)
    return spark.read.text(at)


@query("SELECT unnest(" + "[" + ", ".join(f"'{t}'" for t in text.DENIED_TERMS) + "]) AS name, 'denied_terms' AS rule_set UNION ALL SELECT unnest(" + "[" + ", ".join(f"'{t}'" for t in text.DENIED_OUTPUTS) + "]), 'denied_outputs'")
def s15_rule_tables(spark, d):
    return tables.rules(spark).where("rule_set <> 'overclaims'").select("name", "rule_set")


@query("SELECT lang, doc_id, source FROM documents")
def s16_partitioned_write(spark, d):
    """A folder for each language, read as one table."""
    at = new_path(spark, "by")
    tables.write_by(table(spark, d, "documents").select("doc_id", "source", "lang"), "lang", at)
    return spark.read.schema("doc_id long, source string, lang string").json(at).select("lang", "doc_id", "source")


@query("SELECT doc_id, sha256(text) AS text_sha256, sha1(text) AS text_sha1 FROM documents")
def s12_text_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.sha1("text").alias("text_sha1"))


@query("SELECT CAST(event_id AS BIGINT) AS event_id, props->>'$.k' AS k, list_sort(json_keys(props)) AS keys FROM events")
def n16_json_access(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.sort_array(F.json_object_keys("props")).alias("keys"))


# URLs and pages


@query(f"SELECT page_id, {_CRAWL('url')} AS crawl_url FROM pages")
def u1_crawl_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.crawl_url(F.col("url")).alias("crawl_url"))


#: Hosts that the allow-list of u2 names.
_HOSTS = ["blog.tionsh.example.net", "thther.example.org", "blog.ththan.example.net", "blog.tiontion.example.com", "m.ththth.example.net", "www.ththhe.example.com", "ththed.example.org"]
@query(f"""SELECT page_id, url FROM pages WHERE lower({_part(1)}) IN ('http', 'https') AND {_part(2)} IN ({", ".join(f"'{h}'" for h in _HOSTS)})
  AND NOT regexp_matches(lower({_PATH('url')}), '\\.({"|".join(urls.ASSETS)})$') AND (starts_with({_PATH('url')}, '/en') OR starts_with({_PATH('url')}, '/de'))""")
def u2_allowed_urls(spark, d):
    return table(spark, d, "pages").where(urls.is_allowed(F.col("url"), _HOSTS, ["/en", "/de"])).select("page_id", "url")


_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*"([^"]*)\""""
_ROOT = f"lower({_part(1)}) || '://' || {_part(2)}"


@query(f"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS h FROM pages),
k AS (SELECT page_id, CASE WHEN starts_with(trim(h), '/') THEN {_ROOT} || trim(h) ELSE trim(h) END AS h FROM h WHERE starts_with(trim(h), '/') AND NOT starts_with(trim(h), '//') OR regexp_matches(trim(h), '(?i)^https?://'))
SELECT page_id, {_CRAWL('h')} AS link, count(*) AS n FROM k GROUP BY ALL""")
def u3_root_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(crawl.root_links(F.col("html"), F.col("url"))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


#: References of several forms to the word w of a page's root-relative link.
_FORMS = ("/{w}", "{w}", "../{w}?x=1", "./a/../{w}/.", "?q={w}", "//cdn.example.org/{w}#top", "../../../../{w}//b/..", "https://other.example.org/{w}/")
_BASE_PATH = _part(3)
_FOLD = lambda p: f"""list_reduce(string_split({p}, '/')[2:], lambda b, x: CASE WHEN x IN ('', '.') THEN b WHEN x = '..' THEN regexp_replace(b, '/[^/]*$', '') ELSE b || '/' || x END, '') || CASE WHEN string_split({p}, '/')[-1] IN ('', '.', '..') THEN '/' ELSE '' END"""


@query(f"""WITH h AS (SELECT page_id, url, substr(unnest(regexp_extract_all(html, '{_HREF}', 1)), 2) AS w FROM pages),
f AS (SELECT page_id, url, unnest([{", ".join("'" + f.replace("{w}", "' || w || '") + "'" for f in _FORMS)}]) AS f FROM h),
g AS (SELECT page_id, url, regexp_replace(f, '#.*$', '') AS f, {_ROOT} AS root, lower({_part(1)}) AS scheme, {_BASE_PATH} AS bp, {_part(4)} AS bq FROM f),
m AS (SELECT *, {_part(3, 'f')} AS p, CASE WHEN {_part(4, 'f')} <> '' THEN '?' || {_part(4, 'f')} ELSE '' END AS q FROM g),
n AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p WHEN bp = '' THEN '/' || p ELSE regexp_replace(bp, '[^/]*$', '') || p END AS merged FROM m)
SELECT page_id, CASE WHEN regexp_matches(f, '^https?:') THEN f WHEN starts_with(f, '//') THEN scheme || ':' || f WHEN p = '' THEN root || bp || q ELSE root || {_FOLD('merged')} || q END AS link, count(*) AS n FROM n GROUP BY ALL""")
def u3_resolved_links(spark, d):
    """Links of every relative form to what pages link to, resolved against the pages."""
    h = table(spark, d, "pages").select("page_id", "url", F.explode(crawl.hrefs(F.col("html"))).alias("h")).select("page_id", "url", F.expr("substring(h, 2)").alias("w"))
    anchors = [F.concat(F.lit('<a href="'), F.lit(a), "w", F.lit(b), F.lit('">x</a> ')) for a, b in (f.split("{w}") for f in _FORMS)]
    page = h.select("page_id", "url", F.concat(*anchors).alias("html"))
    links = page.select("page_id", F.explode(crawl.resolved_links(F.col("html"), F.col("url"))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT page_id, url, 'See [one](/docs/' || CAST(page_id AS VARCHAR) || '/) and [two](' || url || ') or [none](ftp://x)' AS t FROM pages),
h AS (SELECT page_id, url, unnest(regexp_extract_all(t, '\\[([^\\]]+)\\]\\((https?://[^)]+|/[^)]+)\\)', 2)) AS h FROM m),
k AS (SELECT page_id, CASE WHEN starts_with(h, '/') THEN {_ROOT} || h ELSE h END AS h FROM h) SELECT page_id, {_CRAWL('h')} AS link FROM k""")
def u4_markdown_links(spark, d):
    t = F.concat(F.lit("See [one](/docs/"), F.col("page_id").cast("string"), F.lit("/) and [two]("), "url", F.lit(") or [none](ftp://x)"))
    return table(spark, d, "pages").select("page_id", F.explode(crawl.markdown_links(t, F.col("url"))).alias("link"))


def _edges(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("src"), (k * 7 % 1501).alias("dst")).unionByName(c.where(k % 3 == 0).select(k.alias("src"), (k + 40).alias("dst")))


def _seeds(spark):
    return tables.literal(spark, [("one", 1), ("five", 5)], "seed string, node long")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey * 7 % 1501 AS dst FROM customer UNION ALL SELECT c_custkey, c_custkey + 40 FROM customer WHERE c_custkey % 3 = 0),
r(seed, node, depth) AS (SELECT unnest(['one', 'five']), CAST(unnest([1, 5]) AS BIGINT), 0 UNION SELECT seed, e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 300)
SELECT seed, CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY seed, node""")
def u5_reachable(spark, d):
    return crawl.reachable(_edges(spark, d), _seeds(spark))


@query()
def u5_capped(spark, d):
    """At most 300 nodes of a seed, the cap of a crawl."""
    return crawl.reachable(_edges(spark, d), _seeds(spark), 300)


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')), ''),
  nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), ''), nullif(list_last(string_split(url, '/')), ''), url) AS title FROM pages""".replace("list_last(string_split(url, '/'))", "string_split(url, '/')[-1]"))
def u6_title(spark, d):
    return table(spark, d, "pages").select("page_id", crawl.title(F.col("html"), F.col("url")).alias("title"))


@query()
def u7_main_text(spark, d):
    return crawl.extracted(table(spark, d, "pages"))


@query(f"SELECT page_id, {_CANONICAL('url')} AS canonical_url FROM pages")
def u8_canonical_document(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_document(F.col("url")).alias("canonical_url"))


@query(with_(RAW) + " SELECT doc_id, regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.md$', '') AS canonical_url FROM raw")
def u9_canonical_source(spark, d):
    return derived.raw_documents(spark, d).select("doc_id", urls.canonical_source(F.col("url")).alias("canonical_url"))


@query(with_(RAW) + " SELECT doc_id, replace(regexp_replace(url, '/+$', ''), '.md', '') AS canonical_url FROM raw")
def u10_canonical_analysis(spark, d):
    return derived.raw_documents(spark, d).select("doc_id", urls.canonical_analysis(F.col("url")).alias("canonical_url"))


@query(with_(RAW) + f" SELECT doc_id, ends_with(lower({_part(3)}), '.md') AS is_markdown, lower(string_split({_part(3)}, '/')[-1]) IN ('llms.txt', 'llms-full.txt', 'codex-manual.md') AS is_aggregate FROM raw")
def u11_url_predicates(spark, d):
    return derived.raw_documents(spark, d).select("doc_id", urls.is_markdown(F.col("url")).alias("is_markdown"), urls.is_aggregate(F.col("url")).alias("is_aggregate"))


@query("""SELECT CASE WHEN contains(u, 'claude.com') THEN 'claude_code' WHEN contains(u, '/api/docs/') THEN 'openai_platform_api' ELSE 'codex_cli' END AS category, count(*) AS n
  FROM (SELECT CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '/api/docs/x' ELSE 'https://code.claude.com/docs/' END AS u FROM pages) GROUP BY 1""")
def u12_category(spark, d):
    p = F.col("page_id") % 3
    u = F.when(p == 0, F.col("url")).when(p == 1, F.concat("url", F.lit("/api/docs/x"))).otherwise("https://code.claude.com/docs/")
    return table(spark, d, "pages").groupBy(urls.category(u).alias("category")).agg(F.count("*").alias("n"))


@query(with_(RAW) + """ SELECT doc_id, CASE WHEN length(title) BETWEEN 1 AND 200 AND NOT contains(title, chr(10)) THEN title
  ELSE coalesce(nullif(string_split(regexp_replace(url, '/+$', ''), '/')[-1], ''), url) END AS title FROM raw""")
def u13_display_title(spark, d):
    return derived.raw_documents(spark, d).select("doc_id", urls.display_title(F.col("title"), F.col("url")).alias("title"))


# Cleaning

_REASON = f"""CASE WHEN content IS NULL OR trim(content) = '' THEN 'missing_content' WHEN url IS NULL OR trim(url) = '' THEN 'missing_url'
  WHEN lower(string_split({_part(3)}, '/')[-1]) IN ('llms.txt', 'llms-full.txt', 'codex-manual.md') THEN 'aggregate_document' WHEN length(content) < {LEAST} THEN 'short_stub' END"""
_STRIP = "regexp_replace(content, '^\\s+|\\s+$', '', 'g')"
_PREFER = f"ends_with(lower({_part(3)}), '.md') DESC, content_length DESC, url DESC, doc_id"
_CLEAN = f"""judged AS (SELECT *, {_REASON} AS r0 FROM raw),
good AS (SELECT doc_id, url, seed_name, {_STRIP} AS content, CAST(length({_STRIP}) AS INTEGER) AS content_length, sha256({_COLLAPSE('content')}) AS content_sha256, {_CANONICAL('url')} AS canonical_url FROM judged WHERE r0 IS NULL),
g1 AS (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY {_PREFER}) AS n1 FROM good),
g2 AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY {_PREFER}) AS n2 FROM g1 WHERE n1 = 1),
outcome AS (SELECT doc_id, CASE WHEN n2 > 1 THEN 'canonical_url_duplicate' END AS reason FROM g2 UNION ALL SELECT doc_id, 'exact_content_duplicate' FROM g1 WHERE n1 > 1 UNION ALL SELECT doc_id, r0 FROM judged WHERE r0 IS NOT NULL)"""


@query(with_(RAW) + f" SELECT doc_id, coalesce({_REASON}, 'passed') AS reason FROM raw")
def f1_reasons(spark, d):
    return derived.raw_documents(spark, d).select("doc_id", F.coalesce(clean.reason(F.col("content"), F.col("url"), LEAST), F.lit("passed")).alias("reason"))


@query(with_(RAW) + f" SELECT doc_id, CAST(length({_STRIP}) AS INTEGER) AS content_length, {_CANONICAL('url')} AS canonical_url, sha256({_COLLAPSE('content')}) AS content_sha256 FROM raw")
def f2_normalised(spark, d):
    return clean.normalise(derived.raw_documents(spark, d)).select("doc_id", "content_length", "canonical_url", "content_sha256")


@query("""SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM (
  SELECT CASE WHEN length(text) < 800 THEN 'short_stub' WHEN row_number() OVER (PARTITION BY length(text) < 800, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) DESC, doc_id DESC) > 1
  THEN 'exact_content_duplicate' END AS reason FROM documents) GROUP BY 1""")
def f_clean_outcomes(spark, d):
    """Rejection, normalisation and exact deduplication of documents without URLs, counted by outcome."""
    docs = table(spark, d, "documents")
    docs = docs.select("doc_id", F.length("text") < LEAST, F.sha2(text.collapse(F.col("text")), 256).alias("h"), F.length(urls.strip(F.col("text"))).alias("n")).toDF("doc_id", "stub", "h", "n")
    nth = F.row_number().over(Window.partitionBy("stub", "h").orderBy(F.desc("n"), F.desc("doc_id")))
    out = docs.select(F.when(F.col("stub"), "short_stub").when(nth > 1, "exact_content_duplicate").otherwise("kept").alias("outcome"))
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query(with_(RAW, _CLEAN) + " SELECT doc_id, coalesce(reason, 'kept') AS outcome FROM outcome")
def f3_f4_deduplicated(spark, d):
    return clean.clean(derived.raw_documents(spark, d), LEAST).select("doc_id", F.coalesce("reason", F.lit("kept")).alias("outcome"))


@query(with_(RAW, _CLEAN) + f""" SELECT doc_id, reason, url, {_CANONICAL('url')} AS canonical_url, seed_name, CAST(length(coalesce(g.content, r.content)) AS INTEGER) AS content_length, sha256({_COLLAPSE('r.content')}) AS content_sha256
  FROM outcome JOIN raw r USING (doc_id) LEFT JOIN (SELECT doc_id, content FROM good) g USING (doc_id) WHERE reason IS NOT NULL""")
def f5_excluded(spark, d):
    return clean.excluded(derived.raw_documents(spark, d), LEAST)


@query(with_(RAW, _CLEAN) + " SELECT url, canonical_url, content_length, content_sha256, seed_name FROM good JOIN outcome USING (doc_id) WHERE reason IS NULL")
def f6_public_columns(spark, d):
    return clean.clean(derived.raw_documents(spark, d), LEAST).where("reason is null").select("url", "canonical_url", "content_length", "content_sha256", "seed_name")


@query(with_(CORPUS) + " SELECT doc_id, substr(sha256(canonical_url), 1, 16) AS short_id FROM corpus")
def f7_short_ids(spark, d):
    return derived.corpus(spark, d).select("doc_id", clean.short_id(F.col("canonical_url")).alias("short_id"))


@query(with_(QA) + " SELECT id, CASE WHEN id % 11 = 0 THEN 'fixed ' || CAST(id AS VARCHAR) ELSE question END AS question FROM qa")
def f8_patched(spark, d):
    q = derived.qa(spark, d)
    fixes = q.where("id % 11 = 0").select("id", F.concat(F.lit("fixed "), F.col("id").cast("string")).alias("value"))
    return clean.patched(q, fixes, "id", "question").select("id", "question")


@query(with_(QA) + " SELECT id FROM qa WHERE category = 'odd' AND (contains(lower(question), 'the') OR contains(lower(answer), 'the') OR contains(lower(topic), 'the') OR contains(lower(array_to_string(keywords, ' ')), 'the'))")
def f10_search(spark, d):
    q = derived.qa(spark, d)
    hit = F.lit(False)
    for c in (F.col("question"), F.col("answer"), F.col("topic"), F.array_join("keywords", " ")):
        hit = hit | F.contains(F.lower(c), F.lit("the"))
    return q.where((F.col("category") == "odd") & hit).select("id")


@query(with_(RAW) + """ SELECT doc_id, length(content) < 300 AS is_short, ends_with(url, '.md') AS is_markdown,
  row_number() OVER (PARTITION BY sha1(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id) > 1 AS is_duplicate FROM raw""")
def f11_inspection(spark, d):
    r = derived.raw_documents(spark, d)
    nth = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    r = r.withColumn("h", F.sha1(urls.strip(F.col("content"))))
    return r.select("doc_id", (F.length("content") < 300).alias("is_short"), F.col("url").endswith(".md").alias("is_markdown"), (nth > 1).alias("is_duplicate"))


@query(with_(QA, ANSWERS) + """ SELECT id, category, model, CASE WHEN id % 2 = 0 THEN answer END AS shown, dense_rank() OVER (ORDER BY category) AS facet FROM answers JOIN qa q2 USING (id)""".replace("CASE WHEN id % 2 = 0 THEN answer END", "CASE WHEN id % 2 = 0 THEN answers.answer END"))
def f12_facets(spark, d):
    q = derived.qa(spark, d)
    facets = q.select("category").distinct()
    facets = facets.withColumn("facet", F.dense_rank().over(Window.orderBy("category")).cast("long"))
    a = derived.answers(spark, d).join(q.select("id", "category"), "id").join(F.broadcast(facets), "category")
    return a.select("id", "category", "model", F.when(F.col("id") % 2 == 0, F.col("answer")).alias("shown"), "facet")


@query(with_(QA, ANSWERS) + " SELECT id, model, answer FROM answers")
def f13_wide_and_long(spark, d):
    return evaluation.separate(evaluation.combined(derived.answers(spark, d)))


# Joins


@query(with_(CORPUS) + " SELECT doc_id, doc_id % 20 = 0 AS qa_source FROM corpus")
def j1_source_flag(spark, d):
    c = derived.corpus(spark, d)
    return split.flag_sources(c, c.where("doc_id % 20 = 0").select("canonical_url")).select("doc_id", "qa_source")


@query(with_(CORPUS) + " SELECT canonical_url || 'x' AS canonical_url FROM corpus WHERE doc_id % 20 = 0 AND doc_id % 40 <> 0")
def j2_missing_sources(spark, d):
    c = derived.corpus(spark, d)
    wanted = c.where("doc_id % 20 = 0").select(F.when(F.col("doc_id") % 40 == 0, F.col("canonical_url")).otherwise(F.concat("canonical_url", F.lit("x"))).alias("canonical_url"))
    return wanted.join(c, "canonical_url", "left_anti")


@query(with_(RAW) + """ SELECT row_id, doc_id FROM (SELECT q.doc_id AS row_id, r.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY r.doc_id) AS n
  FROM raw q JOIN raw r ON q.url = r.url WHERE q.doc_id % 10 = 0) WHERE n = 1""")
def j3_first_source(spark, d):
    r = derived.raw_documents(spark, d)
    q = r.where("doc_id % 10 = 0").select(F.col("doc_id").alias("row_id"), F.col("url"))
    nth = F.row_number().over(Window.partitionBy("row_id").orderBy("doc_id"))
    return q.join(r.select("doc_id", "url"), "url").withColumn("n", nth).where("n = 1").select("row_id", "doc_id")


_SRC = lambda u: f"regexp_replace(regexp_replace(trim({u}), '/+$', ''), '\\.md$', '')"


@query(with_(RAW, "q AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 2 = 0 THEN url ELSE url || '/' END AS source_url FROM raw WHERE doc_id % 7 = 0)", "e AS (SELECT row_id, doc_id, 'exact' AS how FROM q JOIN raw ON source_url = url)")
       + f" SELECT * FROM e UNION ALL SELECT row_id, doc_id, 'canonical' FROM q JOIN raw ON {_SRC('source_url')} = {_SRC('url')} WHERE row_id NOT IN (SELECT row_id FROM e)")
def j4_source_fallback(spark, d):
    r = derived.raw_documents(spark, d)
    q = r.where("doc_id % 7 = 0").select(F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/"))).alias("source_url"))
    return leakage.sources_for(q, r, urls.canonical_source)


@query("""SELECT l.doc_id, CASE WHEN l.doc_id % 4 = 0 THEN 'train' WHEN l.doc_id % 4 = 1 AND d.doc_id IS NOT NULL THEN 'test' ELSE 'absent' END AS place
  FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def j7_provenance(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    train, test = (docs.where(F.col("doc_id") % 4 == k).withColumn(n, F.lit(True)) for k, n in ((0, "in_train"), (1, "in_test")))
    out = lab.join(train, "doc_id", "left").join(test, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("in_train"), "train").when(F.col("in_test"), "test").otherwise("absent").alias("place"))


@query(with_(QA, ANSWERS, SCORES) + """ SELECT q.id, q.question, a.answer AS tuned_answer, s.score AS first_score FROM qa q LEFT JOIN (SELECT * FROM answers WHERE model = 'tuned') a ON a.id = q.id
  LEFT JOIN (SELECT * FROM scores WHERE model = 'tuned' AND judge = 'first') s ON s.id = q.id""")
def j8_joined_view(spark, d):
    """On repeated ids the last row would win; the surrogates have none."""
    a = derived.answers(spark, d).where("model = 'tuned'").select("id", F.col("answer").alias("tuned_answer"))
    s = derived.judge_scores(spark, d).where("model = 'tuned' and judge = 'first'").select("id", F.col("score").alias("first_score"))
    return derived.qa(spark, d).select("id", "question").join(a, "id", "left").join(s, "id", "left")


@query(with_(SCORES) + " SELECT a.id, a.model, a.score AS first, b.score AS second FROM scores a JOIN scores b ON a.id = b.id AND a.model = b.model AND a.judge = 'first' AND b.judge = 'second'")
def j9_aligned_judges(spark, d):
    s = derived.judge_scores(spark, d)
    return s.where("judge = 'first'").select("id", "model", F.col("score").alias("first")).join(s.where("judge = 'second'").select("id", "model", F.col("score").alias("second")), ["id", "model"])


@query(with_(QA) + " SELECT 'chat_differs' AS rule, CAST(id AS VARCHAR) AS row_id, 'answer' AS detail FROM qa WHERE id % 13 = 0")
def j10_v3_parity(spark, d):
    q = derived.qa(spark, d).select("id", "question", "answer")
    chat = q.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.when(F.col("id") % 13 == 0, F.concat("answer", F.lit("!"))).otherwise(F.col("answer")).alias("content"))))
    chat = chat.select("id", F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))
    return verify.differing(q, chat, "id", ["question", "answer"], "chat_differs")


@query(with_(QA) + """, o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position, count(*) OVER () AS n FROM qa)
SELECT 'chat_differs' AS rule, CAST(position AS VARCHAR) AS row_id, '' AS detail FROM o WHERE id % 13 = 0 AND position < n - 1 UNION ALL SELECT 'chat_row', CAST(n - 1 AS VARCHAR), 'missing' FROM o WHERE position = 0
UNION ALL SELECT 'row_index', CAST(position AS VARCHAR), '' FROM o WHERE id % 17 = 0 UNION ALL SELECT 'output_hash', CAST(position AS VARCHAR), '' FROM o WHERE id % 11 = 0 UNION ALL SELECT 'items_row', CAST(n AS VARCHAR), 'extra' FROM o WHERE position = 0""")
def j10_v3_positions(spark, d):
    """Three files held against each other by position: chat rows with some answers changed and the last one gone; metadata with wrong indexes and digests and one row too many."""
    q = derived.qa(spark, d).select("id", F.col("question").alias("instruction"), F.col("answer").alias("output"))
    last = q.agg(F.max("id").alias("m"), F.count("*").alias("n")).first()
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = q.select("id", F.array(message("user", F.col("instruction")), message("assistant", F.when(F.col("id") % 13 == 0, F.concat("output", F.lit("!"))).otherwise(F.col("output")))).alias("messages"))
    ordered = _ordered_lines(q.select("id", F.to_json(F.struct("id", "instruction", "output")).alias("value")), "id", "instructions")
    rows = numbered.read_jsonl_numbered(spark, ordered, "id long, instruction string, output string")
    meta = rows.select("id", F.when(F.col("id") % 17 == 0, F.col("position") + 1).otherwise(F.col("position")).alias("row_index"), F.sha2("instruction", 256).alias("instruction_sha256"), F.sha2(F.when(F.col("id") % 11 == 0, "?").otherwise(F.col("output")), 256).alias("output_sha256"))
    meta = meta.unionByName(spark.range(1).select((F.lit(last.m) + 1).alias("id"), F.lit(last.n).cast("long").alias("row_index"), F.lit("").alias("instruction_sha256"), F.lit("").alias("output_sha256")))
    chat_at = _ordered_lines(chat.where(F.col("id") < last.m).select("id", F.to_json(F.struct("messages")).alias("value")), "id", "chat")
    meta_at = _ordered_lines(meta.select("id", F.to_json(F.struct("row_index", "instruction_sha256", "output_sha256")).alias("value")), "id", "metadata")
    chat = numbered.read_jsonl_numbered(spark, chat_at, "messages array<struct<role:string,content:string>>").drop("file")
    items = numbered.read_jsonl_numbered(spark, meta_at, "row_index long, instruction_sha256 string, output_sha256 string").drop("file")
    return verify.positional_parity(rows.select("position", "instruction", "output"), chat, items)


@query(with_(QA, SCORES) + """ SELECT q.id, q.question, CASE WHEN q.id % 3 = 0 THEN q.answer || ' (again)' ELSE q.answer END AS answer, s.score AS first_score FROM qa q LEFT JOIN (SELECT id, max(score) AS score FROM scores WHERE judge = 'first' GROUP BY id) s ON s.id = q.id""")
def j8_last_row_wins(spark, d):
    """The joined view of files in which ids are there several times: of each id the last row counts."""
    q = derived.qa(spark, d)
    answers = q.select("id", F.posexplode(F.array(F.lit("first try"), F.col("answer"), F.when(F.col("id") % 3 == 0, F.concat("answer", F.lit(" (again)"))))).alias("k", "answer")).where("answer is not null")
    scores = derived.judge_scores(spark, d).where("judge = 'first'").select("id", F.col("score").alias("k"), F.col("model"))
    read = {}
    for name, rows, columns in (("answer", answers, ("id", "answer")), ("score", scores, ("id", "k", "model"))):
        keyed = rows.withColumn("place", F.col("k").cast("long") * 1_000_000_000 + F.col("id"))  # all of the first rows, then all of the second
        at = _ordered_lines(keyed.select("place", F.to_json(F.struct(*columns)).alias("value")), "place", name)
        read[name] = numbered.last_rows(numbered.read_jsonl_numbered(spark, at, "id long, answer string" if name == "answer" else "id long, k int, model string").drop("file"), "id")
    view = q.select("id", "question").join(read["answer"].select("id", "answer"), "id", "left")
    return view.join(read["score"].select("id", F.col("k").alias("first_score")), "id", "left")


@query(with_(QA, SCORES) + """, ids AS (SELECT id, 'qa' AS t FROM qa UNION SELECT id, 'scores' FROM scores UNION SELECT conv_id * 1000, 'even' FROM conversations)
  SELECT 'id_sets_differ' AS rule, CAST(id AS VARCHAR) AS row_id, array_to_string(list_filter(['even', 'qa', 'scores'], lambda x: NOT list_contains(list(t), x)), ',') AS detail FROM ids GROUP BY id HAVING count(*) < 3""")
def j12_id_sets(spark, d):
    even = table(spark, d, "conversations").select((F.col("conv_id") * 1000).alias("id"))
    return verify.same_ids({"qa": derived.qa(spark, d).select("id"), "scores": derived.judge_scores(spark, d).select("id"), "even": even}, "id")


# Aggregations


@query(with_(RAW, _CLEAN) + " SELECT reason, count(*) AS n FROM outcome WHERE reason IS NOT NULL GROUP BY reason")
def a1_reason_counts(spark, d):
    return clean.clean(derived.raw_documents(spark, d), LEAST).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


_HALF = "s AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN 'test' ELSE 'train' END AS split, doc_id % 20 = 0 AS qa_source FROM corpus)"


def _half(spark, d):
    return derived.corpus(spark, d).withColumns({"split": F.when(F.col("doc_id") % 4 == 1, "test").otherwise("train"), "qa_source": F.col("doc_id") % 20 == 0})


@query(with_(CORPUS, _HALF) + """ SELECT split, seed_name, count(*) AS documents, CAST(sum(content_length) AS BIGINT) AS characters, CAST(sum(token_count) AS BIGINT) AS content_tokens, CAST(sum(CASE WHEN qa_source THEN 1 ELSE 0 END) AS BIGINT) AS qa_source_documents
  FROM s GROUP BY GROUPING SETS ((split, seed_name), (split))""")
def a2_split_stats(spark, d):
    return split.split_stats(_half(spark, d))


@query(with_(CORPUS, _HALF) + """ SELECT sum(CASE WHEN split = 'test' THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS test_document_ratio, CAST(sum(CASE WHEN split = 'test' THEN token_count ELSE 0 END) AS DOUBLE) / CAST(sum(token_count) AS DOUBLE) AS test_token_ratio,
  CAST(0 AS BIGINT) AS url_overlap FROM s""")
def a3_split_ratios(spark, d):
    s = _half(spark, d)
    test = F.col("split") == "test"
    overlap = split.leaks(s).where("rule = 'url_in_both_splits'").agg(F.count("*").alias("url_overlap"))
    out = s.agg(F.coalesce(F.try_divide(F.sum(test.cast("double")), F.count("*")), F.lit(0.0)).alias("test_document_ratio"),
                F.coalesce(F.try_divide(F.sum(F.when(test, F.col("token_count")).otherwise(0)).cast("double"), F.sum("token_count")), F.lit(0.0)).alias("test_token_ratio"))
    return out.join(overlap)


@query(with_(CORPUS, _HALF) + """ SELECT split, lang AS category, count(*) AS documents, CAST(sum(content_length) AS BIGINT) AS characters, CAST(sum(token_count) AS BIGINT) AS tokens,
  100.0::DOUBLE * sum(token_count) / sum(sum(token_count)) OVER (PARTITION BY split) AS share_percent FROM s GROUP BY split, lang""")
def a4_composition(spark, d):
    out = _half(spark, d).groupBy("split", F.col("lang").alias("category")).agg(F.count("*").alias("documents"), F.sum("content_length").cast("long").alias("characters"), F.sum("token_count").alias("tokens"))
    w = Window.partitionBy("split")
    basis = F.when(F.sum("tokens").over(w) > 0, F.sum("tokens").over(w)).otherwise(F.sum("characters").over(w))
    value = F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(F.col("characters"))
    return out.withColumn("share_percent", F.coalesce(F.try_divide(100.0 * value, basis), F.lit(0.0)))


@query("SELECT 'all' AS what, min(length(text)) AS least, avg(length(text)) AS mean, max(length(text)) AS most, list(length(text) ORDER BY length(text) DESC)[1:5] AS top FROM documents")
def a5_length_stats(spark, d):
    n = table(spark, d, "documents").select(F.length("text").cast("long").alias("n"))
    top = n.orderBy(F.desc("n")).limit(5).agg(F.sort_array(F.collect_list("n"), asc=False).alias("top"))
    return n.agg(F.lit("all").alias("what"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).join(top)


@query("SELECT sha256(question) AS question_sha256, n FROM (SELECT text AS question, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, question LIMIT 10)")
def a6_duplicate_questions(spark, d):
    """Whole texts of documents stand for questions, since no turn is there twice."""
    return evaluation.duplicate_questions(table(spark, d, "documents").select(F.col("text").alias("question"))).select(F.sha2("question", 256).alias("question_sha256"), "n")


_ALNUM = lambda c: f"array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"


@query(with_(QA, ANSWERS) + f""", b AS (SELECT model, a.answer, q.answer AS reference, q.keywords FROM answers a JOIN qa q ON q.id = a.id),
k AS (SELECT model, answer, unnest(keywords) AS k FROM b),
h AS (SELECT model, count(*) AS keyword_total, CAST(sum(CASE WHEN contains({_ALNUM('answer')}, {_ALNUM('k')}) THEN 1 ELSE 0 END) AS BIGINT) AS keyword_hits FROM k GROUP BY model)
SELECT b.model, count(*) AS items, avg(CASE WHEN trim(answer) <> '' THEN 1.0::DOUBLE ELSE 0 END) AS nonempty_rate, avg(CASE WHEN length(answer) <= 100 THEN 1.0::DOUBLE ELSE 0 END) AS under_100_chars_rate, avg(length(answer)) AS average_answer_chars,
avg(CASE WHEN {_ALNUM('answer')} = {_ALNUM('reference')} THEN 1.0::DOUBLE ELSE 0 END) AS normalized_exact_match_rate, any_value(keyword_total) AS keyword_total, any_value(keyword_hits) AS keyword_hits,
CAST(any_value(keyword_hits) AS DOUBLE) / any_value(keyword_total) AS keyword_recall FROM b JOIN h ON h.model = b.model GROUP BY b.model""")
def a7_answer_metrics(spark, d):
    return evaluation.answer_metrics(derived.answers(spark, d), derived.qa(spark, d))


@query(with_(QA, ANSWERS) + " SELECT model, CAST(sum(CASE WHEN contains(substr(lower(answer), 21), 'question:') THEN 1 ELSE 0 END) AS BIGINT) AS continuations, CAST(sum(CASE WHEN trim(answer) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS nonempty FROM answers GROUP BY model")
def a8_continuations(spark, d):
    return evaluation.continuations(derived.answers(spark, d))


@query(with_(QA, ANSWERS) + """ SELECT x.model || '__' || y.model AS pair, CAST(sum(CASE WHEN x.answer = y.answer THEN 1 ELSE 0 END) AS BIGINT) AS matches FROM answers x JOIN answers y ON x.id = y.id
  AND (x.model = 'base' AND y.model IN ('tuned', 'short') OR x.model = 'tuned' AND y.model = 'short') GROUP BY 1""")
def a9_pairwise_matches(spark, d):
    return evaluation.pairwise_matches(derived.answers(spark, d), [("base", "tuned"), ("base", "short"), ("tuned", "short")])


_MAP = """m AS (SELECT id, model, chr(64 + CAST(row_number() OVER (PARTITION BY id ORDER BY sha256('7:' || CAST(id AS VARCHAR) || ':' || model), model) AS INTEGER)) AS letter
  FROM (SELECT doc_id AS id, unnest(['base', 'tuned', 'short']) AS model FROM labels))"""


def _judged(spark, d):
    """Judgements in letters, from the first judge's scores: the best model wins, two best ones tie."""
    m = evaluation.hashed_map(table(spark, d, "labels").select(F.col("doc_id").alias("id")), MODELS, 7)
    s = derived.judge_scores(spark, d).where("judge = 'first'").join(m, ["id", "model"])
    best = s.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("letter", "score"))).alias("scores"), F.max("score").alias("top"), F.array_sort(F.collect_list(F.struct(-F.col("score"), "letter"))).alias("o"))
    letters = F.map_keys(F.map_filter("scores", lambda k, v: v == F.col("top")))
    return best.select("id", F.when(F.size(letters) == 1, letters[0]).otherwise("Tie").alias("winner"), "scores"), m


@query(with_(SCORES) + """, f AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM scores WHERE judge = 'first'), g AS (SELECT *, sum(CASE WHEN score = top THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS tops FROM f),
w AS (SELECT id, CASE WHEN any_value(tops) > 1 THEN 'Tie' ELSE max(CASE WHEN score = top THEN model END) END AS model FROM g GROUP BY id)
SELECT n.model, (SELECT count(*) FROM w WHERE w.model = n.model) AS wins, (SELECT avg(score) FROM f WHERE f.model = n.model) AS mean_score FROM (SELECT unnest(['base', 'tuned', 'short', 'Tie']) AS model) n""")
def a10_standings(spark, d):
    judged, m = _judged(spark, d)
    return evaluation.standings(evaluation.unblinded(judged, m), MODELS)


@query(f"WITH {_MAP} SELECT letter, count(*) FILTER (WHERE model = 'base') AS base, count(*) FILTER (WHERE model = 'tuned') AS tuned, count(*) FILTER (WHERE model = 'short') AS short FROM m GROUP BY letter")
def a11_position_balance(spark, d):
    m = evaluation.hashed_map(table(spark, d, "labels").select(F.col("doc_id").alias("id")), MODELS, 7)
    return evaluation.position_balance(m, MODELS)


@query(with_(SCORES) + """, f AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM scores WHERE judge = 'first'), g AS (SELECT *, sum(CASE WHEN score = top THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS tops FROM f),
t AS (SELECT model, avg(score) AS mean_score, CAST(sum(CASE WHEN score = top THEN 1 ELSE 0 END) AS BIGINT) AS wins_with_ties, CAST(sum(CASE WHEN score = top AND tops = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_wins FROM g GROUP BY model)
SELECT *, CAST(row_number() OVER (ORDER BY mean_score DESC, model) AS INTEGER) AS rank FROM t""")
def a12_ranking(spark, d):
    return evaluation.ranking(derived.judge_scores(spark, d).where("judge = 'first'"))


_SUBSETS = "ss AS (SELECT doc_id AS id, 'all' AS subset, quality = 1 AS good FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sft_seen' ELSE 'heldout' END, quality = 1 FROM labels)"


def _subsets(spark, d):
    part = F.array(F.lit("all"), F.when(F.col("doc_id") % 3 == 0, "sft_seen").otherwise("heldout"))
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.explode(part).alias("subset"), (F.col("quality") == 1).alias("good"))


@query(with_(SCORES, _SUBSETS) + """, f AS (SELECT subset, scores.* FROM scores JOIN ss USING (id) WHERE judge = 'first'), g AS (SELECT *, max(score) OVER (PARTITION BY subset, id) AS top FROM f),
h AS (SELECT *, sum(CASE WHEN score = top THEN 1 ELSE 0 END) OVER (PARTITION BY subset, id) AS tops FROM g),
t AS (SELECT subset, model, avg(score) AS mean_score, CAST(sum(CASE WHEN score = top THEN 1 ELSE 0 END) AS BIGINT) AS wins_with_ties, CAST(sum(CASE WHEN score = top AND tops = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_wins FROM h GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY subset ORDER BY mean_score DESC, model) AS INTEGER) AS rank FROM t""")
def a12_subset_ranking(spark, d):
    scores = derived.judge_scores(spark, d).where("judge = 'first'").join(_subsets(spark, d), "id")
    return evaluation.ranking(scores.select("subset", "id", "model", "score"), "subset")


@query(with_(SCORES, _SUBSETS) + """, f AS (SELECT subset, good, scores.* FROM scores JOIN ss USING (id) WHERE judge = 'first'), v AS (SELECT unnest(['tuned', 'short']) AS model, unnest(['base', 'tuned']) AS source)
SELECT f.subset, f.model, v.source, count(*) AS items, avg(f.score) AS mean_score, avg(f.score) FILTER (WHERE f.good) AS good_mean, avg(f.score - b.score) AS delta
FROM f JOIN v USING (model) LEFT JOIN scores b ON b.judge = 'first' AND b.id = f.id AND b.model = v.source GROUP BY ALL""")
def a12_subset_deltas(spark, d):
    """Mean scores by subset, and their difference to the mean of the model that a model was made from."""
    return evaluation.subset_deltas(derived.judge_scores(spark, d).where("judge = 'first'").drop("judge"), _subsets(spark, d), {"tuned": "base", "short": "tuned"})


@query(with_(QA, ANSWERS) + ", v AS (SELECT model, list_sort(list(CAST(length(answer) AS INTEGER))) AS v FROM answers GROUP BY model) SELECT model, list_avg(v) AS mean, list_median(v) AS median, v[least(CAST(floor(len(v) * 95 / 100.0) AS BIGINT), len(v) - 1) + 1] AS p95 FROM v")
def a13_answer_lengths(spark, d):
    a = derived.answers(spark, d).select("model", F.length("answer").alias("n"))
    return evaluation.lengths(a, "model", "n")


@query(with_(QA) + " SELECT count(*) AS n, count(DISTINCT id) AS distinct_ids, count(DISTINCT question) AS distinct_questions, count(*) = count(DISTINCT id) AS ids_unique FROM qa")
def a14_expectations(spark, d):
    q = derived.qa(spark, d)
    return q.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.count_distinct("question").alias("distinct_questions"), (F.count("*") == F.count_distinct("id")).alias("ids_unique"))


_RUNS = """runs AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'b' ELSE 'a' END AS run, count(*) AS optimizer_steps, CAST(sum(l_quantity) AS BIGINT) AS target_tokens, 'full' AS mode,
  CAST(sum(l_quantity) AS DOUBLE) / count(*) AS tokens_per_second, CAST(count(*) AS DOUBLE) AS training_seconds, CAST(sum(l_orderkey % 5) AS DOUBLE) / count(*) AS loss FROM lineitem GROUP BY 1)"""


@query("WITH " + _RUNS + """ SELECT list_filter([CASE WHEN a.mode <> b.mode THEN 'mode' END, CASE WHEN a.optimizer_steps <> b.optimizer_steps THEN 'optimizer_steps' END, CASE WHEN a.target_tokens <> b.target_tokens THEN 'target_tokens' END], lambda x: x IS NOT NULL) AS failed_checks,
  b.tokens_per_second / a.tokens_per_second AS tokens_per_second_ratio, b.training_seconds / a.training_seconds AS training_seconds_ratio, b.loss - a.loss AS loss_difference FROM runs a, runs b WHERE a.run = 'a' AND b.run = 'b'""")
def a15_run_comparison(spark, d):
    runs = table(spark, d, "lineitem").groupBy(F.when(F.col("l_linenumber") % 2 == 0, "b").otherwise("a").alias("run")).agg(
        F.count("*").alias("optimizer_steps"), F.sum("l_quantity").cast("long").alias("target_tokens"), F.lit("full").alias("mode"), (F.sum("l_quantity") / F.count("*")).alias("tokens_per_second"),
        F.count("*").cast("double").alias("training_seconds"), (F.sum(F.col("l_orderkey") % 5).cast("double") / F.count("*")).alias("loss"),
    )
    return evaluation.run_comparison(runs, "a", "b")


@query("SELECT l_linestatus AS run, CAST(sum((l_orderkey % 7) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS loss, exp(least(CAST(sum((l_orderkey % 7) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE), 20)) AS perplexity FROM lineitem GROUP BY 1")
def a16_weighted_loss(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("run"), (F.col("l_orderkey") % 7).alias("loss"), F.col("l_quantity").cast("long").alias("tokens"))
    return evaluation.weighted_loss(b, "run")


@query("SELECT l_linestatus AS run, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(1 + l_orderkey % 3) AS DOUBLE) AS tokens_per_second FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1")
def a17_throughput(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("run"), F.col("l_linenumber").alias("step"), F.col("l_quantity").cast("long").alias("tokens"), (1 + F.col("l_orderkey") % 3).alias("seconds"))
    return evaluation.throughput(s, 3, "run")


@query("SELECT source AS seed_name, count(*) AS n FROM documents GROUP BY 1")
def a18_seed_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("seed_name")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n = 3 THEN '3' ELSE '3+' END AS sentences, count(*) AS rows FROM
  (SELECT len(list_filter(string_split_regex(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n FROM conversations) GROUP BY 1""")
def a19_sentence_histogram(spark, d):
    n = F.size(F.filter(F.split(urls.strip(F.col("text")), r"(?<=[.!?])\s+"), lambda x: x != ""))
    return table(spark, d, "conversations").groupBy(F.when(n.between(1, 3), n.cast("string")).otherwise("3+").alias("sentences")).agg(F.count("*").alias("rows"))


@query("SELECT event_type, count(*) AS samples, max(value) AS peak, min(value) AS least, max(CASE WHEN user_id % 2 = 0 THEN value END) AS gpu_peak FROM events GROUP BY 1")
def a20_resource_peaks(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("samples"), F.max("value").alias("peak"), F.min("value").alias("least"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("gpu_peak"))


@query("""WITH v AS (SELECT event_type, list_sort(list(CAST(round(value * 4) AS BIGINT))) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, CAST(len(v) AS BIGINT) AS count, list_avg(v) AS mean_seconds, list_median(v) AS median_seconds, v[CAST(ceil(CAST(0.95 AS DOUBLE) * len(v)) AS BIGINT)] AS p95_seconds FROM v""")
def a21_step_timing(spark, d):
    e = table(spark, d, "events").where("value is not null").select("event_type", F.round(F.col("value") * 4).cast("long").alias("v"))
    return evaluation.timing(e, "v", "event_type")


@query(with_(QA) + " SELECT split, min(length(answer)) AS least, avg(length(answer)) AS mean, max(length(answer)) AS most FROM qa GROUP BY 1")
def a22_output_lengths(spark, d):
    n = F.length("answer").cast("long")
    return derived.qa(spark, d).groupBy("split").agg(F.min(n).alias("least"), F.avg(n).alias("mean"), F.max(n).alias("most"))


# Statistics


@query("""WITH v AS (SELECT event_type, list_sort(list(CAST(round(value * 4) AS BIGINT))) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[CAST(ceil(0.5::DOUBLE * len(v)) AS BIGINT)] AS nearest_rank,
  v[least(CAST(floor(len(v) * 50 / 100.0) AS BIGINT), len(v) - 1) + 1] AS floor_index, list_median(v) AS median FROM v""")
def p1_p2_p3_percentiles(spark, d):
    e = table(spark, d, "events").where("value is not null").select("event_type", F.round(F.col("value") * 4).cast("long").alias("v"))
    ranks = {"nearest_rank": evaluation.nearest_rank_of(0.5), "floor_index": evaluation.floor_rank_of(50), **evaluation.halves_of()}
    found = evaluation.at_ranks(e, "v", ("event_type",), ranks)
    return found.select("event_type", "nearest_rank", "floor_index", evaluation.middle().alias("median"))


@query("SELECT o_orderkey, CAST(printf('%.2f', o_totalprice / 7) AS DOUBLE) AS rounded FROM orders")
def p9_rounded(spark, d):
    """Half to even on the exact binary value."""
    return table(spark, d, "orders").select("o_orderkey", text.rounded(F.col("o_totalprice") / 7, 2).alias("rounded"))


@query(with_(SCORES) + """ SELECT n, round(r, 9) AS r FROM (SELECT count(*) AS n, corr(CAST(a.score AS DOUBLE), CAST(b.score AS DOUBLE)) AS r FROM scores a JOIN scores b ON a.id = b.id AND a.model = b.model AND a.judge = 'first' AND b.judge = 'second')""")
def p4_pearson(spark, d):
    return evaluation.pearson(j9_aligned_judges(spark, d), "first", "second").select("n", F.round("r", 9).alias("r"))


_COMPARE = [("base", "tuned"), ("tuned", "short")]
_SPLITS = "sp AS (SELECT doc_id AS id, unnest(['all', CASE WHEN doc_id % 3 = 0 THEN 'seen' ELSE 'heldout' END]) AS split FROM labels)"
_DELTAS = "dl AS (SELECT split, a.model || '__to__' || b.model AS comparison, a.judge, a.id, CAST(b.score - a.score AS DOUBLE) AS delta FROM scores a JOIN scores b ON a.id = b.id AND a.judge = b.judge AND (a.model, b.model) IN (('base', 'tuned'), ('tuned', 'short')) JOIN sp ON sp.id = a.id)"


def _deltas(spark, d):
    lab = table(spark, d, "labels")
    splits = lab.select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("all"), F.when(F.col("doc_id") % 3 == 0, "seen").otherwise("heldout"))).alias("split"))
    return evaluation.deltas(derived.judge_scores(spark, d), splits, _COMPARE)


@query(with_(SCORES, _SPLITS, _DELTAS) + """ SELECT split, comparison, judge, count(*) AS n, avg(delta) AS mean_delta, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses,
  CAST(sum(CASE WHEN delta = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM dl GROUP BY ALL""")
def p5_p6_paired_effects(spark, d):
    return evaluation.paired(_deltas(spark, d))


@query()
def p5_bootstrap_intervals(spark, d):
    return evaluation.bootstrap(_deltas(spark, d))


@query(with_(SCORES, _SPLITS, _DELTAS) + """, c AS (SELECT split, comparison, judge, avg(delta) > 0.1 AS significant FROM dl GROUP BY ALL), a AS (SELECT count(DISTINCT significant) = 1 AS agree FROM c GROUP BY split, comparison)
  SELECT CAST(sum(CASE WHEN agree THEN 1 ELSE 0 END) AS BIGINT) AS agreeing, CAST(sum(CASE WHEN agree THEN 0 ELSE 1 END) AS BIGINT) AS disagreeing FROM a""")
def p7_concordance(spark, d):
    return evaluation.concordance(_deltas(spark, d).groupBy("split", "comparison", "judge").agg((F.avg("delta") > 0.1).alias("significant")))


_ITEMS = "items AS (SELECT item_id AS id, list_distinct(regexp_extract_all(text, '[a-z]{3,}')[1:3]) AS keywords FROM benchmark)"


_COUNTS = """k AS (SELECT DISTINCT unnest(keywords) AS k FROM items), n AS (SELECT k, CAST(sum((length(text) - length(replace(text, k, ''))) / length(k)) AS BIGINT) AS n FROM documents, k WHERE contains(text, k) GROUP BY k),
e AS (SELECT id, unnest(keywords) AS k FROM items), m AS (SELECT id, min(coalesce(n, 0)) AS min_occurrences, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_occurrences FROM e LEFT JOIN n USING (k) GROUP BY id),
b AS (SELECT *, CASE WHEN min_occurrences = 0 THEN '0' WHEN min_occurrences < 5 THEN '1-4' WHEN min_occurrences < 20 THEN '5-19' ELSE '20+' END AS bucket FROM m),
sc AS (SELECT id, max(CASE WHEN model = 'base' THEN score END) AS base, max(CASE WHEN model = 'tuned' THEN score END) AS tuned FROM scores WHERE judge = 'first' GROUP BY id)"""


def _exposed(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(F.slice(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0)), 1, 3)).alias("keywords"))
    return evaluation.exposure(items, table(spark, d, "documents"))


def _item_scores(spark, d):
    s = derived.judge_scores(spark, d).where("judge = 'first'")
    return s.groupBy("id").agg(*(F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in ("base", "tuned")))


@query(with_(SCORES, _ITEMS, _COUNTS) + " SELECT *, round(ln(1 + min_occurrences), 9) AS log_min_occurrences, round(ln(1 + total_occurrences), 9) AS log_total_occurrences FROM b")
def p8_exposure(spark, d):
    out = _exposed(spark, d).withColumn("bucket", evaluation.exposure_bucket(F.col("min_occurrences")))
    return out.withColumns({c: F.round(c, 9) for c in ("log_min_occurrences", "log_total_occurrences")})


@query(with_(SCORES, _ITEMS, _COUNTS) + """ SELECT unnest(['min_occurrences', 'total_occurrences']) AS count, n, round(unnest([a, z]), 9) AS r
  FROM (SELECT count(*) AS n, corr(ln(1 + min_occurrences), CAST(tuned AS DOUBLE)) AS a, corr(ln(1 + total_occurrences), CAST(tuned AS DOUBLE)) AS z FROM b JOIN sc USING (id))""")
def p8_correlations(spark, d):
    return evaluation.exposure_correlations(_exposed(spark, d), _item_scores(spark, d).select("id", F.col("tuned").alias("score"))).withColumn("r", F.round("r", 9))


@query(with_(SCORES, _ITEMS, _COUNTS) + " SELECT bucket, count(*) AS items, avg(base) AS base_mean, avg(tuned) AS tuned_mean, avg(tuned - base) AS delta FROM b JOIN sc USING (id) GROUP BY bucket")
def p8_buckets(spark, d):
    return evaluation.exposure_buckets(_exposed(spark, d), _item_scores(spark, d))


# Hashing and splitting


@query(with_(CORPUS) + f" SELECT doc_id, {_FRACTION('''('42|' || canonical_url)''')} AS fraction FROM corpus")
def h1_stable_fraction(spark, d):
    return derived.corpus(spark, d).select("doc_id", text.stable_fraction(42, F.col("canonical_url")).alias("fraction"))


_SEED = "seeds AS (SELECT source AS seed_name, 42 + CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_reverse(string_split(source, '')), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: (a * 256 + b) % 1000003) AS BIGINT) AS seed FROM (SELECT DISTINCT source FROM documents))"


@query("WITH " + _SEED + " SELECT seed_name, seed FROM seeds")
def h2_source_seed(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("seed_name")).distinct().select("seed_name", text.source_seed(42, F.col("seed_name")).alias("seed"))


@query(with_(CORPUS, _SEED) + f""", c AS (SELECT doc_id, canonical_url, corpus.seed_name, doc_id % 20 = 0 AS qa_source, {_FRACTION("(CAST(seed AS VARCHAR) || '|' || canonical_url)")} AS fraction FROM corpus JOIN seeds ON seeds.seed_name = corpus.seed_name),
w AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY seed_name, qa_source ORDER BY fraction, canonical_url) AS nth, sum(CASE WHEN fraction < 0.25 THEN 1 ELSE 0 END) OVER p AS lows FROM c WINDOW p AS (PARTITION BY seed_name, qa_source))
SELECT doc_id, NOT qa_source AND n >= 2 AND CASE WHEN lows = 0 THEN nth = 1 WHEN lows = n THEN nth < n ELSE fraction < 0.25 END AS initial_test FROM w""")
def h3_hash_split(spark, d):
    c = derived.corpus(spark, d).withColumn("qa_source", F.col("doc_id") % 20 == 0)
    return split.hash_split(c).select("doc_id", "initial_test")


@query()
def h4_h5_token_split(spark, d):
    c = derived.corpus(spark, d).withColumn("qa_source", F.col("doc_id") % 20 == 0)
    return split.split(c).select("doc_id", "seed_name", "split")


@query(with_(CORPUS, _HALF) + " SELECT 'qa_source_in_test' AS rule, canonical_url FROM s WHERE qa_source AND split = 'test'")
def h6_leaks(spark, d):
    return split.leaks(_half(spark, d))


@query()
def h7_blind_map(spark, d):
    return evaluation.blind_map(table(spark, d, "labels").select(F.col("doc_id").alias("id")), MODELS, 20260815)


@query(f"WITH {_MAP} SELECT id, letter, model FROM m")
def h7_hashed_map(spark, d):
    return evaluation.hashed_map(table(spark, d, "labels").select(F.col("doc_id").alias("id")), MODELS, 7)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256('5|' || CAST(doc_id AS VARCHAR))) - 1 AS BIGINT) AS place FROM labels")
def h8_block_order(spark, d):
    """Rows in the order of a digest."""
    key = F.sha2(F.concat(F.lit("5|"), F.col("doc_id").cast("string")), 256)
    from loomfield.plans.prefix import bits_for, high_bits, prefix_in_groups
    from loomfield.plans.shared import materialize

    b = materialize(table(spark, d, "labels").select("doc_id", key.alias("h"), F.lit(0).alias("g"), F.lit(1).cast("long").alias("one")), "order")
    b = b.withColumn("b", high_bits(F.conv(F.substring("h", 1, 15), 16, 10).cast("long"), bits_for(b.count())))
    return prefix_in_groups(b, "g", "b", ["h"], "one", "place").select("doc_id", "place")


# Blocks


@query(with_(CORPUS) + " SELECT doc_id, token_count FROM corpus")
def k1_word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(blocks.words(F.col("text"))).alias("token_count"))


@query()
def k1_token_ids(spark, d):
    """Numbers of ids by a public vocabulary; tests hold them against the library's."""
    from public_tokenizers import path

    ids = blocks.token_ids(F.col("text"), blocks.vocabulary(path("word_bpe_49k.json")))
    return table(spark, d, "documents").select("doc_id", F.size(ids).alias("token_count"))


_STREAM = """st AS (SELECT doc_id, canonical_url, split, token_count AS n, ('0x' || substr(sha256('42|' || split || '|' || canonical_url), 1, 15))::BIGINT AS key FROM s)"""


@query(with_(CORPUS, _HALF, _STREAM) + " SELECT doc_id, CAST(coalesce(sum(n + 1) OVER (PARTITION BY split ORDER BY key, canonical_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM st")
def k2_stream_starts(spark, d):
    s = _half(spark, d).select("doc_id", "split", "canonical_url", F.col("token_count").alias("n"))
    return blocks.starts(s).select("doc_id", "start")


@query(with_(CORPUS, _HALF, _STREAM) + """, o AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY split ORDER BY key, canonical_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM st),
t AS (SELECT o.split, o.start + i - 1 AS pos, CASE WHEN i > o.n THEN 0 ELSE length(w[i]) END AS id FROM o JOIN (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) x ON x.doc_id = o.doc_id, unnest(range(1, o.n + 2)) AS u(i))
SELECT split, CAST(pos // 256 AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS used, CAST(sum((pos % 256 + 1) * id) AS BIGINT) AS weighted FROM t GROUP BY 1, 2""")
def k2_packed_blocks(spark, d):
    """Blocks of 256 tokens, a token's id being its length; told by how many are used and the sum of ids by place."""
    s = _half(spark, d).select("split", "canonical_url", F.transform(blocks.words(F.col("text")), F.length).alias("ids"))
    b = blocks.pack(s, 256, 0, -1)
    weighted = F.aggregate(F.transform(F.filter("input_ids", lambda x: x >= 0), lambda x, i: (i.cast("long") + 1) * x), F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select("split", "block", F.size(F.filter("attention_mask", lambda m: m)).alias("used"), weighted.alias("weighted"))


@query(with_(CORPUS, _HALF) + """ SELECT split, count(*) AS documents, CAST(sum(token_count) AS BIGINT) AS content_tokens, CAST(sum(token_count) + count(*) AS BIGINT) AS non_padding_tokens, CAST(ceil((sum(token_count) + count(*)) / 256.0) AS BIGINT) AS blocks,
  CAST(ceil((sum(token_count) + count(*)) / 256.0) AS BIGINT) * 256 - CAST(sum(token_count) + count(*) AS BIGINT) AS padding_tokens, count(*) AS eos_tokens FROM s GROUP BY split""")
def k3_pack_stats(spark, d):
    return blocks.pack_stats(_half(spark, d).select("split", F.col("token_count").alias("n")), 256)


_IDS = "x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\S+'), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM documents)"


@query("WITH " + _IDS + " SELECT doc_id, list_transform(ids, lambda i: CASE WHEN i > 3 THEN i ELSE -100 END) AS labels, CAST(len(list_filter(ids[2:], lambda i: i > 3)) AS INTEGER) AS target_tokens FROM x")
def k4_labels(spark, d):
    ids = F.transform(blocks.words(F.col("text")), F.length)
    x = table(spark, d, "documents").select("doc_id", ids.alias("ids")).withColumn("mask", F.transform("ids", lambda i: i > 3))
    return x.select("doc_id", blocks.labels(F.col("ids"), F.col("mask")).alias("labels"), blocks.target_tokens(F.col("mask")).alias("target_tokens"))


@query(with_(QA) + """, t AS (SELECT id, list_transform(regexp_extract_all(question, '\\S+'), lambda w: CAST(length(w) AS INTEGER)) AS p, list_transform(regexp_extract_all(answer, '\\S+'), lambda w: CAST(length(w) AS INTEGER)) AS a FROM qa)
  SELECT id, list_concat(p, a, [0])[1:256] AS ids, list_transform(range(1, least(256, len(p) + len(a) + 1) + 1), lambda i: CASE WHEN i <= len(p) THEN -100 ELSE list_concat(p, a, [0])[i] END) AS labels FROM t WHERE len(p) < 256""")
def k5_instruction_examples(spark, d):
    ids = lambda c: F.transform(blocks.words(F.col(c)), F.length)
    fit = derived.qa(spark, d).where(F.size(ids("question")) < 256)  # a longer one would fail the job
    return fit.select("id", blocks.instruction_example(ids("question"), ids("answer"), 0, 256).alias("x")).select("id", "x.ids", "x.labels")


@query("SELECT p_partkey, CAST(floor(p_size / 6.0) AS BIGINT) * 3 AS steps FROM part")
def k6_optimizer_steps(spark, d):
    return table(spark, d, "part").select("p_partkey", blocks.optimizer_steps(F.col("p_size"), 2, 3, 3).alias("steps"))


@query(with_(QA) + " SELECT id, 'Question: ' || question || chr(10) || 'Answer: ' || answer AS prompt FROM qa")
def k7_prompts(spark, d):
    return derived.qa(spark, d).select("id", blocks.template("Question: {question}\nAnswer: {answer}", question=F.col("question"), answer=F.col("answer")).alias("prompt"))


@query(with_(QA) + " SELECT id, 'seen_' || category || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS running_id FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS n FROM qa)")
def w_running_ids(spark, d):
    return blocks.running_ids(derived.qa(spark, d), "category", "id", "seen", "running_id").select("id", "running_id")


# Text functions


@query(f"SELECT doc_id, sha256({_COLLAPSE('text')}) AS normal_sha256 FROM documents")
def n1_collapsed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("normal_sha256"))


@query()
def n1_n3_exact_forms(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalise_exact(t), 256).alias("normal"), F.sha2(text.alnum_exact(t), 256).alias("alnum"), F.sha2(text.fold_exact(t), 256).alias("folded"))


@query(f"SELECT doc_id, sha256({_ALNUM('text')}) AS alnum_sha256 FROM documents")
def n2_alnum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.alnum(F.col("text")), 256).alias("alnum_sha256"))


_SET = lambda c, p: f"list_distinct(regexp_extract_all(lower({c}), '{p}'))"


@query(f"""WITH p AS (SELECT conv_id, turn, {_SET('text', '[a-z0-9]+')} AS a FROM conversations), q AS (SELECT item_id, {_SET('text', '[a-z0-9]+')} AS b FROM benchmark),
j AS (SELECT conv_id, turn, item_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END AS jaccard FROM p, q)
SELECT conv_id, turn, max(jaccard) AS best FROM j GROUP BY ALL""")
def n4_jaccard(spark, d):
    """Every turn's greatest token similarity to any benchmark item."""
    a = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("row_id"), text.alnum_tokens(F.col("text")).alias("tokens"))
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("eval_id"), F.col("item_id").cast("long").alias("position"), text.alnum_tokens(F.col("text")).alias("tokens"))
    return leakage.best_sets(a, b).select("row_id.conv_id", "row_id.turn", F.col("similarity").alias("best"))


@query()
def n5_sequence_ratio(spark, d):
    """Both sequence ratios of each question and its answer, with the bound that none exceeds."""
    evaluation.ship(spark)
    q = derived.qa(spark, d).select("id", F.lower("question").alias("a"), F.lower("answer").alias("b"))
    return q.select("id", text.sequence_ratio("a", "b").alias("ratio"), text.sequence_ratio_plain("a", "b").alias("plain_ratio"), text.sequence_bound(F.col("a"), F.col("b")).alias("bound"))


@query("WITH t AS (SELECT doc_id, replace(text, ' th', ' `th') AS t FROM documents) SELECT doc_id, regexp_extract_all(t, '`([^`]+)`', 1) AS spans FROM t")
def n6_code_spans(spark, d):
    t = F.replace("text", F.lit(" th"), F.lit(" `th"))
    return table(spark, d, "documents").select("doc_id", text.code_spans(t).alias("spans"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '`[^`]*`', '', 'g'), '[.!?]$', '') AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '[!?]|(^|[^0-9])\\.($|[^0-9])') AS many FROM t""")
def n7_many_sentences(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.many_sentences(F.col("text")).alias("many"))


@query("""WITH t AS (SELECT item_id, '<think>' || substr(text, 1, 9) || '</THINK> "Answer: ' || text || '"' AS t FROM benchmark)
SELECT item_id, regexp_replace(trim(trim(regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g'), '\\s+', ' ', 'g')), '"'), '(?i)^(?:Additional sentence|Answer|Explanation)\\s*:\\s*', '') AS clean FROM t""")
def n8_clean_generated(spark, d):
    t = F.concat(F.lit("<think>"), F.substring("text", 1, 9), F.lit('</THINK> "Answer: '), "text", F.lit('"'))
    return table(spark, d, "benchmark").select("item_id", text.clean_generated(t).alias("clean"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n FROM documents")
def n9_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), F.lit("the")).alias("n"))


_EX = f"""x AS (SELECT id, {_COLLAPSE('answer')} AS w, list_filter(list_transform(keywords, lambda k: lower(trim({_COLLAPSE('k')}, '`* _.:;()[]{{}}"'))), lambda k: k <> '') AS t FROM qa),
y AS (SELECT *, list_transform(t, lambda k: strpos(lower(w), k) - 1) AS a, list_transform(t, lambda k: strpos(lower(w), k) - 1 + length(k)) AS e FROM x)"""


@query(with_(QA, _EX) + """ SELECT id, CASE WHEN len(t) > 0 AND list_min(a) >= 0 THEN CASE WHEN list_max(e) - list_min(a) <= 400 THEN substr(w, greatest(0, list_min(a) - 180) + 1, least(length(w), list_max(e) + 180) - greatest(0, list_min(a) - 180))
  ELSE (SELECT string_agg(p, ' […] ' ORDER BY i) FROM (SELECT p, min(i) AS i FROM (SELECT i, substr(w, greatest(0, a[i] - 140) + 1, least(length(w), e[i] + 180) - greatest(0, a[i] - 140)) AS p FROM unnest(range(1, len(t) + 1)) AS u(i)) GROUP BY p)) END END AS excerpt FROM y""")
def n10_excerpts(spark, d):
    return derived.qa(spark, d).select("id", text.excerpt(F.col("answer"), F.col("keywords"), 400).alias("excerpt"))


@query(with_(QA) + " SELECT id, len(list_filter(keywords, lambda k: NOT contains(lower(question || ' ' || answer), lower(k)))) = 0 AS holds FROM qa")
def n11_required_tokens(spark, d):
    return derived.qa(spark, d).select("id", text.holds_all(F.concat_ws(" ", "question", "answer"), F.col("keywords")).alias("holds"))


@query()
def n10_n11_n13_folded(spark, d):
    """The forms that fold case: excerpts, required tokens, and the rules for an added sentence, each answer being added to its question."""
    q = derived.qa(spark, d)
    whole = F.concat_ws(" ", "question", "answer")
    found = q.select("id", text.excerpt(F.col("answer"), F.col("keywords"), 400, exact=True).alias("excerpt"), text.holds_all(whole, F.col("keywords"), exact=True).alias("holds"), text.addition_violations(F.col("answer"), F.col("question")).alias("violations"))
    return found


@query(with_(QA) + """ SELECT id, list_filter([CASE WHEN NOT length(question) + 1 + length(answer) BETWEEN 100 AND 300 THEN 'combined_length' END, CASE WHEN regexp_matches(answer, '\n|Question:|Answer:') THEN 'continuation' END, CASE WHEN NOT length(answer) BETWEEN 45 AND 180 THEN 'length' END,
  CASE WHEN NOT regexp_matches(answer, '[.!?]\n?$') THEN 'no_end_mark' END, CASE WHEN regexp_matches(answer, '(?i)""" + "|".join(text.OVERCLAIMS) + """') THEN 'overclaim' END, CASE WHEN contains(lower(question), lower(answer)) OR contains(lower(answer), lower(question)) THEN 'repeats' END], lambda x: x IS NOT NULL) AS violations FROM qa""")
def n13_added_sentences(spark, d):
    """Each answer as a sentence added to its question; no turn has code or flags."""
    return derived.qa(spark, d).select("id", text.addition_violations(F.col("answer"), F.col("question"), exact=False).alias("violations"))


_TERMS = "[" + ", ".join(f"'{t}'" for t in text.DENIED_TERMS) + "]"


_SAID = {0: " Coding Agent and rm -rf / MCP", 1: " RM -Rf / then Git RESET --HARD", 2: " docker SYSTEM prune; CHMOD 777; kill -9 1", 3: " git clean -xdF\nanswer: no"}


@query(f"""WITH t AS (SELECT item_id, text || CASE CAST(item_id % 5 AS INTEGER) {" ".join(f"WHEN {k} THEN {' || chr(10) || '.join(f"'{p}'" for p in v.split(chr(10)))}" for k, v in _SAID.items())} ELSE '' END AS t FROM benchmark)
SELECT item_id, list_filter({_TERMS}, lambda x: contains(lower(t), x)) AS terms, list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{n}' END" for n, p in text.DENIED_OUTPUTS.items())}], lambda x: x IS NOT NULL) AS outputs FROM t""")
def n12_denied(spark, d):
    """Items with denied terms and outputs added, in letters of either case."""
    said = F.coalesce(*(F.when(F.col("item_id") % 5 == k, F.lit(v)) for k, v in _SAID.items()), F.lit(""))
    t = F.concat("text", said)
    return table(spark, d, "benchmark").select("item_id", text.denied_terms(t).alias("terms"), text.matching(t, text.DENIED_OUTPUTS).alias("outputs"))


@query(with_(QA, ANSWERS) + """ SELECT id, model, list_filter([CASE WHEN trim(answer) = '' THEN 'empty_output' END, CASE WHEN length(answer) > 100 THEN 'too_long' END, CASE WHEN regexp_matches(answer, '[\\r\\n]') THEN 'newline' END,
  CASE WHEN NOT regexp_matches(answer, '[.!?]\\n?$') THEN 'no_end_mark' END, CASE WHEN regexp_matches(answer, '[.!?]\\n?$') AND regexp_matches(regexp_replace(answer, '[.!?]$', ''), '[!?]|(^|[^0-9])\\.($|[^0-9])') THEN 'many_sentences' END,
  CASE WHEN regexp_matches(answer, '#[0-9]') THEN 'numbered_placeholder' END], lambda x: x IS NOT NULL) AS violations FROM answers""")
def n13_format_rules(spark, d):
    return derived.answers(spark, d).select("id", "model", text.format_violations(F.lit(""), F.col("answer")).alias("violations"))


@query(with_(QA, ANSWERS) + ", w AS (SELECT q.id, a.answer AS s, q.answer AS f FROM qa q JOIN answers a ON a.id = q.id AND a.model = 'short') SELECT id, starts_with(f, s || ' ') AS extends, CASE WHEN starts_with(f, s || ' ') THEN substr(f, length(s) + 2) END AS addition FROM w")
def n14_expansions(spark, d):
    s = derived.answers(spark, d).where("model = 'short'").select("id", F.col("answer").alias("s"))
    q = derived.qa(spark, d).select("id", F.col("answer").alias("f")).join(s, "id")
    extends = F.startswith("f", F.concat("s", F.lit(" ")))
    return q.select("id", extends.alias("extends"), F.when(extends, F.substring("f", F.length("s") + 2, F.length("f"))).alias("addition"))


@query("""WITH t AS (SELECT doc_id, list_concat(regexp_extract_all(lower(text), '\\w+'), ['the', 'end']) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM t), f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, list(w ORDER BY i) AS merged FROM f GROUP BY doc_id""")
def n15_ordered_distinct(spark, d):
    return table(spark, d, "documents").select("doc_id", text.merge_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0)), F.array(F.lit("the"), F.lit("end"))).alias("merged"))


@query("SELECT c_custkey, c_name AS key, c_mktsegment || '=' || CAST(c_nationkey AS VARCHAR) AS path FROM customer")
def n17_key_and_path(spark, d):
    spec = F.concat_ws("=", F.concat(F.lit(" "), "c_name"), "c_mktsegment", F.col("c_nationkey").cast("string"))
    return text.keys_and_paths(table(spark, d, "customer").select("c_custkey", spec.alias("spec")), "spec").drop("spec")


# Duplication

_LINES = """l AS (SELECT lang, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), c AS (SELECT lang, line, count(*) AS n, length(line) AS k FROM l WHERE line <> '' GROUP BY ALL)"""


@query("WITH " + _LINES + """ SELECT lang, 100 * CAST(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS repeated_percent, 100 * CAST(sum(CASE WHEN k >= 20 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN k >= 20 THEN n ELSE 0 END) AS DOUBLE) AS solid_unique_percent,
  100 * CAST(sum(CASE WHEN k >= 20 THEN k * (n - 1) ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN k >= 20 THEN k * n ELSE 0 END) AS DOUBLE) AS duplicate_char_percent FROM c GROUP BY lang""")
def d1_d2_line_metrics(spark, d):
    return duplication.line_metrics(table(spark, d, "documents"), "lang")


_SHINGLES = """w AS (SELECT doc_id, lang, regexp_extract_all(text, '\\S+') AS w FROM documents),
sh AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: md5_number(array_to_string(w[i:i+7], ' '))))) AS s FROM w)"""


@query("WITH " + _SHINGLES + " SELECT doc_id, count(*) AS shingles FROM sh GROUP BY doc_id")
def d3_shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(duplication.shingle_strings(F.col("text"))).cast("long").alias("shingles"))


@query("WITH " + _SHINGLES + """, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), p AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.lang = b.lang AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT p.lang, p.a, p.b, shared, x.n + y.n - shared AS union_size, least(x.n, y.n) AS least FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE CAST(shared AS DOUBLE) / (x.n + y.n - shared) >= 0.3 OR CAST(shared AS DOUBLE) / least(x.n, y.n) >= 0.6""")
def d4_j11_near_pairs(spark, d):
    return duplication.near_pairs(duplication.shingle_table(table(spark, d, "documents"), "lang", "doc_id"), "lang", "doc_id")


@query("WITH " + _SHINGLES + " SELECT lang, 100 * CAST(count(DISTINCT s) AS DOUBLE) / count(*) AS unique_shingle_percent FROM sh GROUP BY lang")
def d5_unique_shingles(spark, d):
    return duplication.unique_percent(duplication.shingle_table(table(spark, d, "documents"), "lang", "doc_id"), "lang")


# Leakage

_EVAL = "ev AS (SELECT 'item' || CAST(item_id AS VARCHAR) AS eval_id, CAST(item_id AS INTEGER) AS position, text AS question, text AS answer FROM benchmark)"


def _leak_rows(spark, d):
    return derived.qa(spark, d).select(F.col("id").alias("row_id"), "question", "answer")


def _evaluation(spark, d):
    """All benchmark items; questions and answers are both held against an item's whole text."""
    b = table(spark, d, "benchmark")
    return b.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("eval_id"), F.col("item_id").cast("int").alias("position"), F.col("text").alias("question"), F.col("text").alias("answer"))


_WJ = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_WORD = r"[\pL\pM\p{Nd}_]+"
_J5 = f"""r AS (SELECT id AS row_id, {_SET('question', _WORD)} AS q, {_SET('answer', _WORD)} AS a FROM qa), e AS (SELECT eval_id, position, {_SET('question', _WORD)} AS eq, {_SET('answer', _WORD)} AS ea FROM ev),
sc AS (SELECT row_id, eval_id, position, {_WJ('q', 'eq')} AS question_jaccard, {_WJ('a', 'ea')} AS answer_jaccard FROM r, e)"""


@query(with_(QA, _EVAL, _J5) + " SELECT row_id, eval_id, question_jaccard, answer_jaccard FROM sc")
def j5_token_similarity(spark, d):
    return leakage.token_scores(_leak_rows(spark, d), _evaluation(spark, d))


@query(with_(QA, _EVAL, _J5) + " SELECT row_id, eval_id, question_jaccard, answer_jaccard FROM sc WHERE question_jaccard >= 0.1 OR answer_jaccard >= 0.1")
def j5_similar_pairs(spark, d):
    return leakage.token_scores(_leak_rows(spark, d), _evaluation(spark, d), 0.1)


@query(with_(QA, _EVAL, _J5) + """ SELECT row_id, eval_id AS question_jaccard_eval_id, question_jaccard FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY question_jaccard DESC, position) AS n FROM sc WHERE NOT (row_id % 5 = 0 AND eval_id IN ('item1', 'item2'))) WHERE n = 1""")
def j6_v1_unrelated_maxima(spark, d):
    rows, ev = _leak_rows(spark, d), _evaluation(spark, d)
    declared = F.when(F.col("row_id") % 5 == 0, F.array(F.lit("item1"), F.lit("item2")))
    best = leakage.best_sets(rows.select("row_id", text.word_tokens(F.col("question")).alias("tokens"), declared.alias("without")), ev.select("eval_id", "position", text.word_tokens(F.col("question")).alias("tokens")))
    return best.select("row_id", F.col("eval_id").alias("question_jaccard_eval_id"), F.col("similarity").alias("question_jaccard"))


@query()
def v1_v2_audit(spark, d):
    """All four metrics against all evaluation rows."""
    return leakage.audit(_leak_rows(spark, d), _evaluation(spark, d)).withColumn("breaches", F.size("breaches"))


@query(with_(QA) + f""" SELECT q.id AS row_id, side FROM (SELECT id, 'question' AS side, {_ALNUM('question')} AS k FROM qa UNION ALL SELECT id, 'answer', {_ALNUM('answer')} FROM qa) q
  JOIN (SELECT DISTINCT 'question' AS side, {_ALNUM('question')} AS k FROM qa WHERE id % 9 = 0 UNION SELECT DISTINCT 'answer', {_ALNUM('answer')} FROM qa WHERE id % 9 = 0) e USING (side, k)""")
def v1_exact_matches(spark, d):
    q = derived.qa(spark, d)
    return leakage.exact_matches(q.select(F.col("id").alias("row_id"), "question", "answer"), q.where("id % 9 = 0"))


@query(with_(QA) + f""", i AS (SELECT id, question, topic, id % 4 = 0 AS related, id % 5 = 0 AS overlapping, CAST(id % 6 AS INTEGER) AS sources, len(keywords) > 2 AS supported FROM (SELECT * FROM qa UNION ALL SELECT * REPLACE (id + 1000000 AS id, '  ' || translate(question, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS question) FROM qa WHERE category = 'even')),
n AS (SELECT *, row_number() OVER (PARTITION BY lower({_COLLAPSE('question')}) ORDER BY id) AS nth FROM i),
z AS (SELECT id AS eval_id, CASE WHEN nth > 1 THEN 'duplicate_question' WHEN topic = 'topic3' OR length({_COLLAPSE('question')}) > 1000 THEN 'malformed' WHEN related THEN 'declared_relation' WHEN overlapping THEN 'similarity_overlap' WHEN sources <> 1 THEN 'source_count' WHEN NOT supported THEN 'missing_evidence' ELSE 'accepted' END AS reason FROM n)
SELECT *, CASE WHEN reason = 'accepted' THEN 'accepted' ELSE 'excluded' END AS status FROM z""")
def f9_selection(spark, d):
    """Half of the questions are there twice, in capitals the second time."""
    i, q = F.col("id"), derived.qa(spark, d)
    q = q.unionByName(q.where("category = 'even'").withColumns({"id": i + 1_000_000, "question": F.concat(F.lit("  "), F.translate("question", ascii_lowercase, ascii_uppercase))}))
    q = q.select(
        i.alias("eval_id"), i.alias("position"), "question", "topic", (i % 4 == 0).alias("related"), (i % 5 == 0).alias("overlaps"), (i % 6).cast("int").alias("sources"), (F.size("keywords") > 2).alias("supported")
    )
    return leakage.selection(q, ["topic3"]).select("eval_id", "reason", "status")


_TWICE = "i AS (SELECT * FROM qa UNION ALL SELECT * REPLACE (id + 1000000000 AS id, '  ' || translate(question, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS question) FROM qa WHERE category = 'even')"


@query(with_(QA, RAW, _EVAL, _TWICE) + f""", c AS (SELECT i.*, raw.content, CASE WHEN raw.doc_id % 2 = 0 THEN raw.url ELSE raw.url || '/' END AS claimed FROM i LEFT JOIN raw ON raw.doc_id = (i.id % 1000000000) // 1000),
k AS (SELECT * REPLACE (CASE WHEN category = 'even' THEN regexp_extract_all(coalesce(content, ''), '[A-Za-z]{{5,}}')[1:2] ELSE keywords END AS keywords) FROM c),
x AS (SELECT k.id, raw.doc_id, raw.content FROM k JOIN raw ON k.claimed = raw.url),
y AS (SELECT * FROM x UNION ALL SELECT k.id, raw.doc_id, raw.content FROM k JOIN raw ON {_SRC('k.claimed')} = {_SRC('raw.url')} WHERE k.id NOT IN (SELECT id FROM x)),
z AS (SELECT y.id, CAST(count(*) AS INTEGER) AS sources, bool_or(len(k.keywords) > 0 AND len(list_filter(k.keywords, lambda w: NOT contains(lower(y.content), lower(w)))) = 0) AS supported FROM y JOIN k ON k.id = y.id GROUP BY y.id),
o AS (SELECT id, max({_WJ('q', 'eq')}) >= 0.35 AS overlapping FROM (SELECT id, {_SET('question', _WORD)} AS q FROM i), (SELECT {_SET('question', _WORD)} AS eq FROM ev) GROUP BY id),
n AS (SELECT *, row_number() OVER (PARTITION BY lower({_COLLAPSE('question')}) ORDER BY id) AS nth FROM i),
r AS (SELECT n.id AS eval_id, CASE WHEN nth > 1 THEN 'duplicate_question' WHEN topic = 'topic3' OR length({_COLLAPSE('question')}) > 1000 THEN 'malformed' WHEN n.id % 4 = 0 THEN 'declared_relation' WHEN overlapping THEN 'similarity_overlap'
  WHEN coalesce(sources, 0) <> 1 THEN 'source_count' WHEN NOT supported THEN 'missing_evidence' ELSE 'accepted' END AS reason FROM n JOIN o ON o.id = n.id LEFT JOIN z ON z.id = n.id)
SELECT *, CASE WHEN reason = 'accepted' THEN 'accepted' ELSE 'excluded' END AS status FROM r""")
def f9_selected_by_evidence(spark, d):
    """The selection over what the operators find: likeness to evaluation questions, the documents that claimed sources name, and whether those hold the keywords."""
    q, r = derived.qa(spark, d), derived.raw_documents(spark, d)
    q = q.unionByName(q.where("category = 'even'").withColumns({"id": F.col("id") + 1_000_000_000, "question": F.concat(F.lit("  "), F.translate("question", ascii_lowercase, ascii_uppercase))}))
    named = r.select(F.col("doc_id").alias("conv"), F.col("content").alias("said"), F.when(F.col("doc_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/"))).alias("source_url"))
    rows = q.withColumn("conv", F.expr("(id % 1000000000) div 1000")).join(named, "conv", "left")
    long_words = F.slice(F.regexp_extract_all(F.coalesce("said", F.lit("")), F.lit("[A-Za-z]{5,}"), F.lit(0)), 1, 2)
    rows = rows.withColumn("keywords", F.when(F.col("category") == "even", long_words).otherwise(F.col("keywords")))
    sources = leakage.sources_for(rows.select(F.col("id").alias("row_id"), "source_url"), r, urls.canonical_source)
    held = sources.join(r.select("doc_id", "content"), "doc_id").join(rows.select(F.col("id").alias("row_id"), "keywords"), "row_id")
    found = held.groupBy(F.col("row_id").alias("id")).agg(F.count("*").cast("int").alias("sources"), F.bool_or((F.size("keywords") > 0) & text.holds_all(F.col("content"), F.col("keywords"))).alias("supported"))
    stated = _evaluation(spark, d).select("eval_id", "position", text.word_tokens(F.col("question")).alias("tokens"))
    like = leakage.best_sets(q.select("id", text.word_tokens(F.col("question")).alias("tokens")), stated, "id").select("id", (F.coalesce("similarity", F.lit(0.0)) >= leakage.QUESTION_JACCARD).alias("overlaps"))
    items = q.join(found, "id", "left").join(like, "id").select(
        F.col("id").alias("eval_id"), F.col("id").alias("position"), "question", "topic", (F.col("id") % 4 == 0).alias("related"), "overlaps", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("supported", F.lit(False)).alias("supported")
    )
    return leakage.selection(items, ["topic3"]).select("eval_id", "reason", "status")


# Verification


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ['winner'] WHEN c_custkey % 4 = 1 THEN ['score_values'] WHEN c_custkey % 4 = 2 THEN ['reason'] ELSE CAST([] AS VARCHAR[]) END AS problems FROM customer""")
def v6_judge_problems(spark, d):
    k = F.col("c_custkey") % 4
    winner = F.when(k == 0, "Candidate Z").otherwise("Candidate A")
    score = F.when(k == 1, "true").otherwise("7.5")
    raw = F.concat(F.lit('{"winner": "'), winner, F.lit('", "scores": {"Candidate A": '), score, F.lit(', "Candidate B": 1}, "reason": "'), F.when(k == 2, " ").otherwise("good"), F.lit('"}'))
    return table(spark, d, "customer").select("c_custkey", evaluation.judge_problems(raw, ["A", "B"]).alias("problems"))


@query(with_(QA) + """ SELECT 'log_misses_row' AS rule, CAST(id AS VARCHAR) AS row_id, '' AS detail FROM qa WHERE id % 10 = 0 UNION ALL SELECT 'accepted_not_held_out', CAST(id AS VARCHAR), '' FROM qa WHERE id % 7 = 0 AND id % 10 <> 0 AND id % 14 <> 0""")
def v5_held_out_audit(spark, d):
    q = derived.qa(spark, d).select("id")
    log, held = q.where("id % 10 <> 0"), q.where("id % 14 = 0")
    return verify.missing(q, log, "id", "log_misses_row").unionByName(verify.missing(log.where("id % 7 = 0"), held, "id", "accepted_not_held_out"))


@query(with_(QA, ANSWERS) + """ SELECT 'short' AS rule, CAST(id AS VARCHAR) AS row_id, '' AS detail FROM answers WHERE model = 'base' AND NOT length(answer) <= 200 UNION ALL SELECT 'ends', CAST(id AS VARCHAR), '' FROM answers WHERE model = 'base' AND NOT regexp_matches(answer, '[.!?]\\n?$')
  UNION ALL SELECT 'id_repeats', CAST(id AS VARCHAR), 'occurs 3 times' FROM answers WHERE model = 'base'""")
def v7_violations(spark, d):
    a = derived.answers(spark, d)
    base = a.where("model = 'base'")
    return verify.violations(base, "id", {"short": F.length("answer") <= 200, "ends": base["answer"].rlike("[.!?]$")}).unionByName(verify.not_unique(a, "id", "id_repeats"))


@query(with_(CORPUS, _HALF) + """ SELECT 'stats_differ' AS rule, split AS row_id, 'documents' AS detail FROM (SELECT DISTINCT split FROM s) WHERE split = 'test'""")
def v4_stored_stats(spark, d):
    """Stored statistics against recomputed ones; the stored number of test documents is one too high."""
    stats = split.split_stats(_half(spark, d)).where("seed_name is null").select("split", "documents", "content_tokens")
    stored = stats.withColumn("documents", F.when(F.col("split") == "test", F.col("documents") + 1).otherwise(F.col("documents")))
    return verify.differing(stats, stored, "split", ["documents", "content_tokens"], "stats_differ")
