"""Views of the driver's tables that stand for the tables of a corpus project, and the same as SQL.

The tables have no documents with URLs, no answers of several models and no judges. Those below are surrogates:
fixed functions of the columns that are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, url, content, seed_name, title. Every 97th URL names an aggregate, every 5th ends in .md and shares its page with the next id."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 97 == 0, "llms.txt").when(F.col("doc_id") % 5 == 0, F.concat((F.col("doc_id") + 1).cast("string"), F.lit(".md"))).otherwise(F.col("doc_id").cast("string"))
    return d.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".Example.org/docs/"), name).alias("url"), F.col("text").alias("content"), F.col("source").alias("seed_name"), F.substring("text", 1, 60).alias("title"))


RAW = """raw AS (SELECT doc_id, 'https://' || source || '.Example.org/docs/' || CASE WHEN doc_id % 97 = 0 THEN 'llms.txt' WHEN doc_id % 5 = 0 THEN CAST(doc_id + 1 AS VARCHAR) || '.md'
  ELSE CAST(doc_id AS VARCHAR) END AS url, text AS content, source AS seed_name, substr(text, 1, 60) AS title FROM documents)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canonical_url, seed_name, content_length, token_count (words), doc_id of all documents; every 20th is a QA source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/docs/"), F.col("doc_id").cast("string")).alias("canonical_url"), F.col("source").alias("seed_name"), F.length("text").alias("content_length"),
        F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("token_count"), "text", "lang",
    )


CORPUS = r"""corpus AS (SELECT doc_id, 'https://' || source || '.example.org/docs/' || CAST(doc_id AS VARCHAR) AS canonical_url, source AS seed_name, CAST(length(text) AS INTEGER) AS content_length,
  CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS token_count, text, lang FROM documents)"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, question, answer, split, category, topic, keywords, source_url: user turns that an assistant turn follows; the three first long words of the answer are keywords."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = c.withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    i = F.col("conv_id") * 1000 + F.col("turn")
    keywords = F.slice(F.array_distinct(F.regexp_extract_all("answer", F.lit("[A-Za-z]{5,}"), F.lit(0))), 1, 3)
    return n.select(
        i.alias("id"), F.col("text").alias("question"), "answer", F.when(F.col("conv_id") % 3 == 0, "sft_seen").otherwise("heldout").alias("split"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("category"),
        F.concat(F.lit("topic"), (F.col("conv_id") % 7).cast("string")).alias("topic"), keywords.alias("keywords"),
    )


QA = r"""turns AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
words_ AS (SELECT *, regexp_extract_all(answer, '[A-Za-z]{5,}') AS w FROM turns WHERE role = 'user' AND next_role = 'assistant'),
qa AS (SELECT conv_id * 1000 + turn AS id, text AS question, answer, CASE WHEN conv_id % 3 = 0 THEN 'sft_seen' ELSE 'heldout' END AS split, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category,
  'topic' || CAST(conv_id % 7 AS VARCHAR) AS topic, list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i])[1:3] AS keywords FROM words_)"""

MODELS = ["base", "tuned", "short"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, model, answer. base answers every third question rightly, tuned every second, short says the first 90 characters."""
    q = qa(spark, sf_dir)
    wrong = F.concat(F.lit("No. Please ask again: Question: "), F.substring("question", 1, 40))
    given = {"base": F.when(F.col("id") % 3 == 0, F.col("answer")).otherwise(wrong), "tuned": F.when(F.col("id") % 2 == 0, F.col("answer")).otherwise(wrong), "short": F.substring("answer", 1, 90)}
    return q.select("id", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), c.alias("answer")) for m, c in given.items()))))


ANSWERS = """answers AS (SELECT id, 'base' AS model, CASE WHEN id % 3 = 0 THEN answer ELSE 'No. Please ask again: Question: ' || substr(question, 1, 40) END AS answer FROM qa
  UNION ALL SELECT id, 'tuned', CASE WHEN id % 2 = 0 THEN answer ELSE 'No. Please ask again: Question: ' || substr(question, 1, 40) END FROM qa
  UNION ALL SELECT id, 'short', substr(answer, 1, 90) FROM qa)"""

JUDGES = ["first", "second"]


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, judge, model, score from 1 to 10, from the labels of documents."""
    lab = table(spark, sf_dir, "labels")
    each = [F.struct(F.lit(j).alias("judge"), F.lit(m).alias("model"), (1 + (F.col("doc_id") * (a + 2 * b + 3) + F.col("quality") * (3 + a) + F.col("toxic") * b) % 10).cast("int").alias("score")) for a, j in enumerate(JUDGES) for b, m in enumerate(MODELS)]
    return lab.select(F.col("doc_id").alias("id"), F.inline(F.array(*each)))


SCORES = "scores AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS id, '{j}' AS judge, '{m}' AS model, CAST(1 + (doc_id * {a + 2 * b + 3} + quality * {3 + a} + toxic * {b}) % 10 AS INTEGER) AS score FROM labels" for a, j in enumerate(JUDGES) for b, m in enumerate(MODELS)
) + ")"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)
