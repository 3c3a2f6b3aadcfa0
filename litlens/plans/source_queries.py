"""Registered queries of the file readers and writers (A) and of resumable ingest (L1, L6, L7). Each writes the derived rows to files in the
shared folder and reads them back through the operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from litlens.operators import evaluate as EV
from litlens.operators import experiments as X
from litlens.operators import hygiene as H
from litlens.operators import sources as S
from litlens.operators import tables as T
from litlens.plans import evaluate_queries, text_queries, vector_queries  # noqa: F401  their SQL is used below
from litlens.plans.base import AS_OF, ORACLES, QUERIES, articles, messages, of_articles, query, table
from litlens.sources import files as A
from litlens.streaming import stateful as L
from litlens.streaming.windows import run_append, shared_folder


def folder(df_or_spark) -> str:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@of_articles("a1_read_jsonl", "SELECT id, title, source FROM articles WHERE id % 10 NOT IN (3, 4)")
def a1(a):
    """Every tenth line is blank, every tenth is cut off."""
    record = F.to_json(F.struct("id", "title", "source"))
    line = F.when(F.col("id") % 10 == 3, "").when(F.col("id") % 10 == 4, F.substring(record, 1, 12)).otherwise(record)
    path = folder(a)
    a.select(line.alias("value")).write.text(path)
    return A.read_jsonl(a.sparkSession, path, "id long, title string, source string")


@of_articles("a8_read_clean_papers", "SELECT id AS article_id, min(title) AS text FROM articles WHERE id % 9 <> 2 AND trim(title) <> '' GROUP BY id ORDER BY id LIMIT 500")
def a8(a):
    """Rows without an id or text, and rows that come twice."""
    rows = a.select(F.when(F.col("id") % 9 == 2, "").otherwise(F.col("id").cast("string")).alias("article_id"), F.col("title").alias("text"))
    path = folder(a)
    A.write_tables({"papers": rows.union(rows.filter("length(text) % 2 = 0"))}, path, "csv")
    return A.read_clean_papers(a.sparkSession, f"{path}/papers", 500)


@of_articles("a7_normalize_atom", "SELECT 'arxiv' AS source, external_id, coalesce(nullif(trim(regexp_replace(title, '[^A-Za-z0-9 ]', '', 'g')), ''), 'Untitled') AS title, publish_date, CASE WHEN id % 2 = 0 THEN 'A. One, ' ELSE '' END || 'B. Two' AS authors, 'http://x.test/abs/' || external_id AS url, pdf_url, CASE WHEN id % 3 = 0 THEN primary_category ELSE split_part(categories, ', ', 1) END AS primary_category, categories, doi, contains(categories, 'cs.') AS is_computer_science FROM articles")
def a7(a):
    """Feeds of entries with and without a date, a link to a file, a primary category and a DOI."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    maybe = lambda c: F.coalesce(c, F.lit(""))
    attr = lambda head, c: F.concat(F.lit(head), c, F.lit('"/>'))
    entry = F.concat_ws(
        "", F.lit("<entry>"), tag("id", F.concat(F.lit("http://x.test/abs/"), "external_id")), tag("title", F.concat(F.lit("\n  "), F.regexp_replace("title", "[^A-Za-z0-9 ]", ""), F.lit(" "))),
        maybe(tag("published", F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.when(F.col("id") % 2 == 0, "<author><name>A. One</name></author>").otherwise("<author><name> </name></author>"), F.lit("<author><name>B. Two</name></author>"),
        F.lit('<link href="http://x.test" rel="alternate"/>'), maybe(attr('<link title="pdf" href="', F.col("pdf_url"))), F.array_join(F.transform(F.split("categories", ", "), lambda c: attr('<category term="', c)), ""),
        F.when(F.col("id") % 3 == 0, attr('<arxiv:primary_category term="', F.col("primary_category"))).otherwise(""), maybe(tag("arxiv:doi", F.col("doi"))), F.lit("</entry>"),
    )
    path = folder(a)
    feeds = a.groupBy(F.expr("id div 200").alias("k")).agg(F.array_join(F.collect_list(entry), "\n").alias("v"))  # two hundred entries a feed
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
    feeds.select(F.concat(F.lit(head), "v", F.lit("</feed>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = a.sparkSession.read.format("xml").option("rowTag", "entry").schema(S.ATOM).load(path)
    return S.normalize_atom(read).select("source", "external_id", "title", "publish_date", "authors", "url", "pdf_url", "primary_category", "categories", "doi", "is_computer_science")


@query("a9_read_golden", "SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question, CAST(len(CASE WHEN item_id % 2 = 0 THEN [item_id] ELSE [item_id, item_id + 1] END) AS INTEGER) AS n_expected, CAST(CASE WHEN item_id % 3 = 0 THEN 5 ELSE item_id % 3 END AS INTEGER) AS top_k FROM benchmark")
def a9(spark, sf):
    """Files of either form."""
    b = table(spark, sf, "benchmark")
    expected = F.when(F.col("item_id") % 2 == 0, F.array("item_id")).otherwise(F.array(F.col("item_id"), F.col("item_id") + 1))
    q = F.struct(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"), expected.alias("expected_article_ids"), F.nullif(F.col("item_id") % 3, F.lit(0)).alias("top_k"))
    path = folder(spark)
    files = b.groupBy(F.expr("item_id div 50").alias("k")).agg(F.collect_list(q).alias("qs"))  # fifty questions a file
    body = F.when(F.col("k") % 2 == 0, F.to_json("qs")).otherwise(F.to_json(F.struct(F.col("qs").alias("questions"))))
    files.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return A.read_golden(spark, path).select("question_id", "question", F.size("expected_article_ids").alias("n_expected"), "top_k")


@query("a10_read_answer_golden", "SELECT CAST(item_id AS VARCHAR) AS gold_id, item_id AS expected_article_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda t: trim(replace(t, ';', ''))), lambda t: t <> ''), '|') AS key_terms FROM benchmark")
def a10(spark, sf):
    b = table(spark, sf, "benchmark")
    terms = F.array_join(F.transform(F.split("text", " "), lambda t: F.regexp_replace(t, ";", "")), " ; ")
    rows = b.select(F.col("item_id").cast("string").alias("gold_id"), F.col("text").alias("question"), F.col("item_id").alias("expected_article_id"), F.substring("text", 1, 30).alias("expected_title"), terms.alias("key_terms"))
    path = folder(spark)
    A.write_tables({"golden": rows}, path, "csv")
    return A.read_answer_golden(spark, f"{path}/golden").select("gold_id", "expected_article_id", F.array_join("key_terms", "|").alias("key_terms"))


@of_articles("a11_read_assignments", "SELECT id AS article_id, cluster_id AS topic FROM articles WHERE cluster_id IS NOT NULL")
def a11(a):
    path = folder(a)
    A.write_tables({"assigned": a.select(F.col("id").alias("article_id"), F.concat(F.col("cluster_id").cast("string"), F.lit(".0")).alias("topic"))}, path, "csv")
    return A.read_assignments(a.sparkSession, f"{path}/assigned")


def same_as(name, other):
    """Registers a query whose rows are those of another one, written and read again."""

    def put(fn):
        QUERIES[name], ORACLES[name] = fn, ORACLES[other]
        return fn

    return put


@same_as("a14_write_hygiene", "c17_hygiene_metrics")
def a14(spark, sf):
    """All tables of the clean path; the metrics are read back."""
    result, path = H.clean_papers(articles(spark, sf)), folder(spark)
    A.write_hygiene(result, H.topic_input(result.clean), path)
    return spark.read.schema("metric string, value double").option("header", True).csv(f"{path}/metrics").select("metric", F.round("value", 6).alias("value"))


@same_as("a15_write_topics", "e6_topic_keywords")
def a15(spark, sf):
    """Info, assignments, keywords and a grid; the keywords are read back."""
    a, path = articles(spark, sf), folder(spark)
    words = QUERIES["e6_topic_keywords"](spark, sf)
    info = a.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    A.write_topics(path, info, a.select("id", "cluster_id"), words, X.run_experiments(a.select("id", "cluster_id", "embedding"), [(0.2, 0.3)]))
    return spark.read.schema(words.schema).option("header", True).csv(f"{path}/keywords")


@same_as("a16_write_eval_report", "h1_score_retrieval")
def a16(spark, sf):
    """A clustering row, the questions' scores and their summary; the scores are read back."""
    a, path = articles(spark, sf), folder(spark)
    scores = T.cut(QUERIES["h1_score_retrieval"](spark, sf))  # read twice
    A.write_eval_report(path, "run-1", "all", AS_OF, EV.cluster_coverage(a), scores, EV.summarize_retrieval(scores))
    return spark.read.schema(scores.schema).option("header", True).csv(f"{path}/run-1/retrieval_results")


@of_articles("a19_snapshots", "SELECT source, count(*) AS n FROM articles GROUP BY 1")
def a19(a):
    """A saved, a refreshed and a deleted snapshot."""
    store = A.SnapshotStore(a.sparkSession, folder(a))
    make = lambda: a.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    store.save("old-1", make())
    store.save("sources", make().limit(0))
    store.save("sources", make())
    if store.delete("old-") != 1 or store.get("old-1") is not None:
        raise RuntimeError("a deleted snapshot is still there")
    return store.refresh("sources", lambda: make().limit(0))


@of_articles("l1_incremental_ingest", "SELECT external_id, arg_max(title, id) AS title FROM articles GROUP BY external_id")
def l1(a):
    """Two loads with one checkpoint; rows of a key that come later win."""
    spark, root = a.sparkSession, folder(a)
    rows, log = a.select("id", "external_id", "title"), L.IngestLog(a.sparkSession, f"{root}/log", "external_id")
    for part in (0, 1):
        rows.filter(F.col("id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        log.ingest(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), "id")
    return log.compact(f"{root}/compact").read().select("external_id", "title")


@query("l6_late_rows", "WITH m AS (SELECT max(ts) AS top FROM events), k AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events, m WHERE ts >= top - INTERVAL 20 DAY GROUP BY 1) SELECT start, n FROM k, m WHERE start + INTERVAL 1 DAY <= top - INTERVAL 2 DAY")
def l6(spark, sf):
    """The newest ten days come first, then the ten before; what comes after them is behind the watermark."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    top, path = e.agg(F.max("ts").alias("top")), folder(spark)
    days = lambda n: F.col("ts") >= F.col("top") - F.expr(f"INTERVAL '{n}' DAY")
    e = e.crossJoin(F.broadcast(top)).withColumn("part", F.when(days(10), 0).when(days(20), 1).otherwise(2))  # one row
    for part in range(3):
        e.filter(F.col("part") == part).select("ts").coalesce(1).write.mode("append").parquet(path)  # a file is a trigger's input
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return L.windows_in_time(stream, "ts", "1 day", "2 days")


@query("l7_summary_due", "SELECT chat_id, count(*) // 3 AS due FROM messages GROUP BY 1 HAVING count(*) >= 3")
def l7(spark, sf):
    path = folder(spark)
    messages(spark, sf).select("chat_id", "id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return run_append(L.due(stream, "chat_id", 3)).groupBy("chat_id").agg(F.sum("due").alias("due"))


