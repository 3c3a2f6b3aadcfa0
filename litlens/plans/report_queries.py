"""Registered queries of groups I and J."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litlens.operators import reports as I
from litlens.operators import topics as E
from litlens.plans.base import AS_OF, articles, clusters, messages, of_articles, query
from litlens.plans.vector_queries import REPS

AGO = f"timestamp '{AS_OF}' - INTERVAL {{}} DAY"
YEAR = f"publish_date >= {AGO.format(365)}"
#: Stored form: outliers have no cluster.
STORED = "st AS (SELECT * EXCLUDE (cluster_id), nullif(cluster_id, -1) AS cluster_id FROM articles)"


def stored(a):
    return a.withColumn("cluster_id", F.nullif("cluster_id", F.lit(-1)))


@of_articles("i1_dashboard_filter", f"SELECT id FROM articles WHERE source = 'arxiv' AND (primary_category = 'cs.CV' OR categories ILIKE '%cs.CV%') AND {YEAR}")
def i1(a):
    return I.dashboard_filter(a, AS_OF, "arxiv", "cs.CV", "12m").select("id")


@of_articles("i2_kpis", f"WITH {STORED} SELECT count(*) AS total_papers, count(DISTINCT cluster_id) AS active_clusters, coalesce(count(cluster_id) / nullif(count(DISTINCT cluster_id), 0), 0) AS avg_papers_per_cluster, count_if(publish_date >= {AGO.format(7)}) AS weekly_picks, count(cluster_id) AS clustered_papers, count(pdf_url) AS pdf_available FROM st WHERE {YEAR}")
def i2(a):
    return I.kpis(I.dashboard_filter(stored(a), AS_OF), AS_OF)


@query("i3_cluster_counts", f"WITH {STORED} SELECT cluster_id, article_count, paper_count FROM clusters JOIN (SELECT cluster_id, count(*) AS paper_count FROM st WHERE {YEAR} GROUP BY cluster_id) USING (cluster_id)")
def i3(spark, sf):
    return I.cluster_counts(I.dashboard_filter(stored(articles(spark, sf)), AS_OF), clusters(spark, sf)).select("cluster_id", "article_count", "paper_count")


@query("i4_pie", "SELECT cluster_id, article_count FROM clusters ORDER BY article_count DESC, cluster_id LIMIT 8")
def i4(spark, sf):
    return I.top_clusters(clusters(spark, sf)).select("cluster_id", "article_count")


@of_articles("i5_monthly_counts", f"SELECT strftime(publish_date, '%Y-%m') AS month_key, count(*) AS count FROM articles WHERE {YEAR} GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def i5(a):
    return I.monthly_counts(I.dashboard_filter(a, AS_OF))


@of_articles("i6_source_distribution", f"SELECT coalesce(source, 'unknown') AS source, count(*) AS count FROM articles WHERE (primary_category = 'cs.CV' OR categories ILIKE '%cs.CV%') AND {YEAR} GROUP BY 1")
def i6(a):
    return I.source_distribution(I.dashboard_filter(a, AS_OF, category="cs.CV"))


@of_articles("i7_category_distribution", "SELECT coalesce(primary_category, 'unknown') AS category, count(*) AS count FROM articles WHERE source = 'arxiv' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def i7(a):
    return I.category_distribution(I.dashboard_filter(a, AS_OF, source="arxiv", period="all"))


SERIES = "se AS (SELECT cluster_id, strftime(publish_date, '%Y-%m') AS month_key, count(*) AS count FROM articles WHERE publish_date IS NOT NULL AND cluster_id IN (SELECT cluster_id FROM clusters ORDER BY article_count DESC, cluster_id LIMIT 8) GROUP BY 1, 2)"


@query("i8_cluster_trends", f"WITH {SERIES} SELECT * FROM se")
def i8(spark, sf):
    return I.cluster_trends(stored(articles(spark, sf)), clusters(spark, sf))


@query("i8_trends_wide", f"WITH {SERIES} SELECT month_key, string_agg(CAST(cluster_id AS VARCHAR) || '=' || CAST(count AS VARCHAR), ',' ORDER BY cluster_id) AS clusters, CAST(sum(count) AS BIGINT) AS total FROM se GROUP BY 1")
def i8w(spark, sf):
    wide = I.trends_wide(I.cluster_trends(stored(articles(spark, sf)), clusters(spark, sf)))
    text = F.array_join(F.transform(F.map_entries("clusters"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return wide.withColumn("clusters", text)


RISING = ", ".join(f"count(*) FILTER (WHERE publish_date >= {AGO.format(k)}) AS last_{k}d, count(*) FILTER (WHERE publish_date >= {AGO.format(2 * k)} AND publish_date < {AGO.format(k)}) AS prev_{k}d" for k in (7, 30, 90))
ACC = {k: f"((coalesce(last_{k}d, 0) - coalesce(prev_{k}d, 0)) / greatest(coalesce(prev_{k}d, 0), 1))" for k in (7, 30, 90)}


@query("i9_rising_topics", f"""WITH {STORED}, n AS (SELECT cluster_id, {RISING} FROM st WHERE cluster_id IS NOT NULL GROUP BY 1)
SELECT cluster_id, article_count AS paper_count, {', '.join(f'coalesce({p}_{k}d, 0) AS {p}_{k}d' for k in (7, 30, 90) for p in ('last', 'prev'))}, {', '.join(f'round({ACC[k]}, 4) AS acceleration_{k}d' for k in (7, 30, 90))}, round(0.5 * {ACC[30]} + 0.3 * {ACC[90]} + 0.2 * {ACC[7]}, 4) AS score
FROM clusters LEFT JOIN n USING (cluster_id) ORDER BY coalesce(last_30d, 0) > 0 DESC, score DESC, coalesce(last_30d, 0) DESC, article_count DESC, cluster_id LIMIT 8""")
def i9(spark, sf):
    return I.rising_topics(stored(articles(spark, sf)), clusters(spark, sf), AS_OF)


@query("i10_cluster_quality", f"""WITH {STORED}, t AS (SELECT cluster_id AS k, article_count AS n FROM clusters ORDER BY article_count DESC, cluster_id LIMIT 1)
SELECT count_if(embedding IS NOT NULL AND cluster_id IS NULL) AS outlier_count, round(count_if(embedding IS NOT NULL AND cluster_id IS NULL) / count(embedding), 4) AS outlier_ratio, (SELECT k FROM t) AS largest_cluster_id, (SELECT n FROM t) AS largest_cluster_count, round((SELECT n FROM t) / count(cluster_id), 4) AS largest_cluster_ratio, count(cluster_id) AS clustered_papers, count(embedding) AS total_with_embedding FROM st""")
def i10(spark, sf):
    return I.cluster_quality(stored(articles(spark, sf)), clusters(spark, sf))


COLOR = "list_extract([" + ", ".join(f"'{c}'" for c in I.COLORS) + "], CAST(abs(cluster_id) % 20 + 1 AS INTEGER))"


@query("i11_cluster_cards", f"SELECT cluster_id, cluster_description AS name, trim(string_split(cluster_description, ',')[1]) AS keyword, {COLOR} AS color FROM clusters")
def i11(spark, sf):
    return I.cluster_cards(clusters(spark, sf)).select("cluster_id", "name", "keyword", "color")


@of_articles("i13_paper_cards", f"""SELECT id, cluster_id, title, 'Unknown Authors - ' || coalesce(nullif(venue, ''), 'Unknown Venue') || coalesce(' (' || CAST(year(publish_date) AS VARCHAR) || ')', '') AS reference,
CASE WHEN length(abstract_text) > 900 THEN regexp_replace(substr(abstract_text, 1, 900), '\\s+$', '') || '...' ELSE coalesce(abstract_text, '') END AS abstract, coalesce(publish_date >= {AGO.format(7)}, FALSE) AS is_weekly_pick, coalesce(citation_count, 0) AS citation_count, pdf_url IS NOT NULL AS has_pdf FROM articles""")
def i13(a):
    return I.paper_cards(a, AS_OF)


@of_articles("i16_bulletin_filter", "SELECT id FROM articles WHERE (primary_category IN ('cs.CL', 'stat.ML') OR categories ILIKE '%cs.CL%' OR categories ILIKE '%stat.ML%') AND publish_date >= timestamp '2020-01-01 00:00:00' AND publish_date <= timestamp '2022-12-31 00:00:00'")
def i16(a):
    return I.bulletin_filter(a, categories=["cs.CL", "stat.ML", " "], start="2020-01-01 00:00:00", end="2022-12-31 00:00:00").select("id")


@of_articles("i17_cluster_papers", f"{REPS} SELECT a.cluster_id, a.id, CAST(row_number() OVER (PARTITION BY a.cluster_id ORDER BY rp.rank NULLS LAST, a.id) AS INTEGER) AS position FROM articles a LEFT JOIN rp ON rp.id = a.id AND rp.cluster_id = a.cluster_id WHERE a.cluster_id >= 0 QUALIFY position <= 15")
def i17(a):
    return I.cluster_papers(a, E.representatives(a), 15)


@of_articles("i18_bulletin", f"{REPS} SELECT a.cluster_id, a.id, round(coalesce(rp.score, 0.8), 6) AS score FROM articles a LEFT JOIN rp ON rp.id = a.id AND rp.cluster_id = a.cluster_id WHERE a.cluster_id >= 0 AND publish_date >= timestamp '2018-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY a.cluster_id ORDER BY rp.rank NULLS LAST, a.id) <= 10")
def i18(a):
    reps = E.representatives(a)
    picked = I.cluster_papers(I.bulletin_filter(a, start="2018-01-01 00:00:00"), reps, 10)
    return picked.join(reps.select("cluster_id", "id", "score"), ["cluster_id", "id"], "left").select("cluster_id", "id", F.round(F.coalesce("score", F.lit(0.8)), 6).alias("score"))


DIGEST = f"""{REPS}, dg AS (SELECT a.*, row_number() OVER (PARTITION BY a.cluster_id ORDER BY round(coalesce(rp.score, 0), 9) DESC, publish_date DESC NULLS LAST, coalesce(citation_count, 0) DESC, a.id) AS position
FROM articles a LEFT JOIN rp ON rp.id = a.id AND rp.cluster_id = a.cluster_id WHERE a.cluster_id >= 0 QUALIFY position <= 12)"""


def digest(a):
    return I.digest_articles(a, I.centrality(E.representatives(a)), 12)


@of_articles("i19_digest_articles", f"{DIGEST} SELECT cluster_id, id, CAST(position AS INTEGER) AS position FROM dg")
def i19(a):
    return digest(a).select("cluster_id", "id", "position")


@of_articles("i20_centrality", f"{REPS} SELECT cluster_id, id, round(coalesce(score, 1 / rank), 6) AS centrality FROM rp")
def i20(a):
    return I.centrality(E.representatives(a)).withColumn("centrality", F.round("centrality", 6))


@query("i21_digest_summary", f"{DIGEST} SELECT cluster_id, 'Cluster ' || CAST(cluster_id AS VARCHAR) || ' contains ' || CAST(count(*) AS VARCHAR) || ' selected real articles related to ' || 'topic ' || CAST(cluster_id AS VARCHAR) || ', label' || '. Representative papers include: ' || string_agg(title, '; ' ORDER BY position) FILTER (WHERE position <= 3) || '. This digest is based only on locally stored article metadata and abstracts.' AS summary FROM dg GROUP BY cluster_id")
def i21(spark, sf):
    return I.digest_summary(digest(articles(spark, sf)), clusters(spark, sf))


@of_articles("i22_digest_highlights", f"""{DIGEST}, cs AS (SELECT cluster_id, string_agg(primary_category, ', ' ORDER BY primary_category) AS cats FROM (SELECT DISTINCT cluster_id, primary_category, dense_rank() OVER (PARTITION BY cluster_id ORDER BY primary_category) AS r FROM dg QUALIFY r <= 5) GROUP BY 1),
ci AS (SELECT cluster_id, title, citation_count FROM dg WHERE citation_count > 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY citation_count DESC, position) = 1)
SELECT cluster_id, concat_ws(' | ', 'Keywords: key' || CAST(cluster_id AS VARCHAR) || ', word 2', 'Top categories: ' || cats, 'Most cited selected paper: ' || title || ' (' || CAST(citation_count AS VARCHAR) || ' citations)') AS highlights FROM cs LEFT JOIN ci USING (cluster_id)""")
def i22(a):
    words = a.filter("cluster_id >= 0 ").select("cluster_id").distinct().select("cluster_id", F.array(F.concat(F.lit("key"), F.col("cluster_id").cast("string")), F.lit("word 2")).alias("keywords"))
    return I.digest_highlights(digest(a), words)


@query("i24_bulletin_options", "SELECT 'category' AS kind, primary_category AS value, count(*) AS paper_count FROM articles WHERE primary_category IS NOT NULL AND primary_category <> '' GROUP BY 2 UNION ALL SELECT 'cluster', CAST(cluster_id AS VARCHAR), article_count FROM clusters WHERE article_count > 0")
def i24(spark, sf):
    return I.bulletin_options(articles(spark, sf), clusters(spark, sf))


@query("i25_user_bulletins", f"""{REPS}, us AS (SELECT DISTINCT user_id FROM events), ra AS (SELECT a.cluster_id, a.id, a.primary_category, rp.rank FROM articles a LEFT JOIN rp ON rp.id = a.id AND rp.cluster_id = a.cluster_id WHERE a.cluster_id >= 0),
pp AS (SELECT cluster_id, id FROM ra QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY rank NULLS LAST, id) <= 3)
SELECT user_id, cluster_id, id FROM us JOIN pp ON cluster_id IN (user_id % 10, user_id % 7) WHERE user_id % 3 <> 0
UNION ALL SELECT user_id, cluster_id, id FROM us JOIN ra ON primary_category IN ('cs.CV', CASE WHEN user_id % 2 = 0 THEN 'math.NA' ELSE 'stat.ML' END) WHERE user_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, cluster_id ORDER BY rank NULLS LAST, id) <= 3""")
def i25(spark, sf):
    """Users choose two clusters or two categories."""
    a, user = articles(spark, sf), F.col("user_id")
    kind = F.when(user % 3 == 0, "categories").otherwise("clusters")
    prefs = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    prefs = prefs.select("user_id", kind.alias("selection_type"), F.array((user % 10).cast("int"), (user % 7).cast("int")).alias("cluster_ids"), F.array(F.lit("cs.CV"), F.when(user % 2 == 0, "math.NA").otherwise("stat.ML")).alias("categories"))
    return I.user_bulletins(prefs, a, E.representatives(a), 3)


@query("i27_search_clusters", "SELECT cluster_id, article_count FROM clusters WHERE contains(lower(cluster_description), 'topic')")
def i27(spark, sf):
    return clusters(spark, sf).filter(F.lower("cluster_description").contains("topic")).orderBy(F.desc("article_count"), "cluster_id").select("cluster_id", "article_count")


@of_articles("i28_weekly_best", f"""{REPS}, wk AS (SELECT a.cluster_id, a.id, coalesce(rp.score, 0.8) AS score FROM articles a LEFT JOIN rp ON rp.id = a.id WHERE publish_date >= {AGO.format(7)})
SELECT part, cluster_id, id, round(score, 6) AS score, CAST(position AS INTEGER) AS position FROM (SELECT 'best' AS part, *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS position FROM wk QUALIFY position <= 6)
UNION ALL SELECT 'cluster', cluster_id, id, round(score, 6), CAST(position AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, id) AS position FROM wk WHERE cluster_id >= 0 QUALIFY position <= 2)""")
def i28(a):
    return I.weekly_best(a, E.representatives(a), AS_OF).withColumn("score", F.round("score", 6))


@query("j1_recent_messages", "SELECT chat_id, id, role FROM messages QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) <= 12")
def j1(spark, sf):
    w = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages(spark, sf).withColumn("_rn", F.row_number().over(w)).filter("_rn <= 12").select("chat_id", "id", "role")


SOURCES = "so AS (SELECT chat_id, id, unnest([(id * 7) % 40, (id * 11) % 40]) AS article_id, unnest([1, 2]) AS pos, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS m FROM messages WHERE role = 'agent')"


@query("j2_previous_sources", f"WITH {SOURCES}, f AS (SELECT chat_id, article_id, min((m - 1) * 2 + pos) AS o FROM so WHERE m <= 12 * 2 GROUP BY 1, 2) SELECT chat_id, article_id FROM f QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY o) <= 10".replace("WHERE m <= 12 * 2 ", "WHERE dense <= 12 ").replace("row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS m", "dense_rank() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS m, dense_rank() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS dense"))
def j2(spark, sf):
    """Previously cited sources: newest messages first, first mention of an article, ten a session."""
    m = messages(spark, sf).filter("role = 'agent'")
    w = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("id"))
    m = m.withColumn("_m", F.row_number().over(w)).filter("_m <= 12")
    cited = m.select("chat_id", "_m", F.posexplode(F.array((F.col("id") * 7) % 40, (F.col("id") * 11) % 40)).alias("_pos", "article_id"))
    first = cited.groupBy("chat_id", "article_id").agg(F.min(F.col("_m") * 2 + F.col("_pos")).alias("_o"))
    o = Window.partitionBy("chat_id").orderBy("_o")
    return first.withColumn("_rn", F.row_number().over(o)).filter("_rn <= 10").select("chat_id", "article_id")


@query("j3_sessions_due", "SELECT chat_id, count(*) AS messages FROM messages GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (WHERE created_at > timestamp '2026-01-01 00:01:00') >= 3")
def j3(spark, sf):
    since = F.count_if(F.col("created_at") > F.lit("2026-01-01 00:01:00").cast("timestamp"))
    return messages(spark, sf).groupBy("chat_id").agg(F.count(F.lit(1)).alias("messages"), since.alias("_since")).filter("messages >= 4 AND _since >= 3").drop("_since")


@query("j4_session_list", "SELECT chat_id, coalesce(nullif(substr(arg_min(content, id), 1, 40), ''), 'New chat') AS title FROM messages GROUP BY 1")
def j4(spark, sf):
    return messages(spark, sf).groupBy("chat_id").agg(F.coalesce(F.nullif(F.substring(F.min_by("content", "id"), 1, 40), F.lit("")), F.lit("New chat")).alias("title"))


@query("j5_session_messages", "SELECT chat_id, id, CASE role WHEN 'agent' THEN 'assistant' ELSE role END AS role, content FROM messages")
def j5(spark, sf):
    return messages(spark, sf).select("chat_id", "id", F.when(F.col("role") == "agent", "assistant").otherwise(F.col("role")).alias("role"), "content")


@query("j6_memory_block", "SELECT chat_id, 'Recent messages:' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content, chr(10) ORDER BY created_at, id) AS block FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) <= 12) GROUP BY 1")
def j6(spark, sf):
    w = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = messages(spark, sf).withColumn("_rn", F.row_number().over(w)).filter("_rn <= 12")
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("content"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", line.alias("l")))), lambda s: s["l"])
    return recent.groupBy("chat_id").agg(F.concat(F.lit("Recent messages:\n"), F.array_join(lines, "\n")).alias("block"))


@query("j7_delete_sessions", "SELECT chat_id, id FROM messages WHERE chat_id NOT IN (SELECT chat_id FROM messages WHERE role = 'system')")
def j7(spark, sf):
    m = messages(spark, sf)
    return m.join(m.filter("role = 'system'").select("chat_id").distinct(), "chat_id", "left_anti").select("chat_id", "id")
