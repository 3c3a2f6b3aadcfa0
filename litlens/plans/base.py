"""The derived views that the registered queries read, once as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every time-dependent query gets this date.
AS_OF = "2026-05-21 00:00:00"

ARTICLES = """
SELECT d.doc_id AS id,
       CASE d.doc_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'openalex' ELSE 'semanticscholar' END AS source,
       'X' || CAST(CASE WHEN d.doc_id % 20 = 19 THEN d.doc_id - 1 ELSE d.doc_id END AS VARCHAR(20)) AS external_id,
       split_part(d.text, chr(10), 1) AS title,
       CASE WHEN d.doc_id % 29 = 7 THEN NULL ELSE substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) END AS abstract_text,
       CASE WHEN d.doc_id % 31 = 5 THEN NULL
            ELSE CAST(date '2016-01-01' + CAST((d.doc_id * 37) % 3793 AS INT) AS TIMESTAMP) END AS publish_date,
       CASE d.doc_id % 8 WHEN 0 THEN 'cs.CV' WHEN 1 THEN 'cs.LG' WHEN 2 THEN 'cs.CL' WHEN 3 THEN 'cs.IT'
            WHEN 4 THEN 'math.NA' WHEN 5 THEN 'stat.ML' WHEN 6 THEN 'eess.SY' ELSE 'quant-ph' END AS primary_category,
       CASE d.doc_id % 3 WHEN 0 THEN 'cs.AI, cs.CV' WHEN 1 THEN 'math.CO' ELSE 'cs.CL, stat.ML' END AS categories,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL
            ELSE '10.1234/' || CAST(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 1 ELSE d.doc_id END AS VARCHAR(20)) END AS doi,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST((d.doc_id * 13) % 97 AS INT) END AS citation_count,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'https://example.test/' || CAST(d.doc_id AS VARCHAR(20)) || '.pdf' END AS pdf_url,
       'venue-' || d.source AS venue, d.lang AS language, e.embedding AS embedding,
       CASE WHEN e.vec_id IS NULL THEN NULL WHEN e.vec_id % 11 = 0 THEN -1 ELSE e.label END AS cluster_id
FROM {d} d LEFT JOIN {e} e ON e.vec_id = d.doc_id
"""
MESSAGES = """
SELECT conv_id AS chat_id, conv_id * 1000 + turn AS id, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text AS content,
       timestamp '2026-01-01 00:00:00' + turn * INTERVAL '1' MINUTE AS created_at FROM {c} c
"""
#: Clusters as their tables are stored: outliers have no cluster.
CLUSTERS = """
SELECT cluster_id, count(*) AS article_count, 'topic ' || CAST(cluster_id AS VARCHAR(20)) || ', label' AS cluster_description
FROM {a} a WHERE cluster_id >= 0 GROUP BY cluster_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ARTICLES, d=table(spark, sf_dir, "documents"), e=table(spark, sf_dir, "embeddings"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES, c=table(spark, sf_dir, "conversations"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLUSTERS, a=articles(spark, sf_dir))


def six(df: DataFrame) -> DataFrame:
    """df with its doubles rounded to 6."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_views(sql: str) -> str:
    """Oracle SQL with the views in front."""
    views = {"articles": ARTICLES.format(d="documents", e="embeddings"), "messages": MESSAGES.format(c="conversations"), "clusters": CLUSTERS.format(a="articles")}
    rest = _long_counts(sql.strip())
    head = "WITH "
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.startswith(start):
            head, rest = start, ", " + rest[len(start) :]
            break
    return head + ", ".join(f"{k} AS ({v.strip()})" for k, v in views.items()) + (rest if rest[:1] == "," else " " + rest)


def _long_counts(sql: str) -> str:
    """count_if is a HUGEINT in DuckDB; Spark's is a long."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += [sql[at:i], "CAST(", sql[i:j], " AS BIGINT)"]
        at = j
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under a name, with its oracle over the views."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return put


def of_articles(name: str, sql: str | None = None):
    """Registers fn(articles)."""

    def put(fn):
        query(name, sql)(lambda spark, sf_dir: fn(articles(spark, sf_dir)))
        return fn

    return put
