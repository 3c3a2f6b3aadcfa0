"""Registered queries of A3, A5, A6, A22, E12, E13, E21, G24, G25, G27, H9, I12, I23, I26 and J8."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litlens.functions import vectors as V
from litlens.operators import evaluate as EV
from litlens.operators import routing as R
from litlens.operators import sources as S
from litlens.operators import topics as E
from litlens.plans.base import AS_OF, clusters, messages, of_articles, query

from litlens.plans.vector_queries import REASSIGN, REPS, UNIT

FIELD = "CASE WHEN primary_category LIKE 'cs.%' THEN 'Computer Science' ELSE primary_category END"


def field():
    return F.when(F.col("primary_category").like("cs.%"), "Computer Science").otherwise(F.col("primary_category"))


def openalex(a):
    """The articles as nested works."""
    name = lambda c: F.struct(c.alias("display_name"))
    none = F.lit(None).cast("string")
    place = lambda pdf, page, venue: F.struct(pdf.alias("pdf_url"), page.alias("landing_page_url"), name(venue).alias("source"))
    topic = F.struct(field().alias("display_name"), name(none).alias("subfield"), name(none).alias("field"), name(none).alias("domain"))
    return a.select(
        F.concat(F.lit("https://openalex.org/"), F.col("external_id")).alias("id"), F.lit("").alias("title"), F.col("title").alias("display_name"), F.create_map(F.lit("two"), F.array(F.lit(1)), F.lit("one"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"),
        F.date_format("publish_date", "yyyy-MM-dd").alias("publication_date"), F.array(F.struct(name(F.col("venue")).alias("author")), F.struct(name(none).alias("author"))).alias("authorships"), place(F.lit(""), none, none).alias("best_oa_location"),
        place(F.col("pdf_url"), none, F.col("venue")).alias("primary_location"), F.struct(F.lit("https://oa.test").alias("oa_url")).alias("open_access"), F.concat(F.lit("https://doi.org/"), F.col("doi")).alias("doi"), name(F.col("primary_category")).alias("primary_topic"),
        F.array(topic).alias("topics"), F.array(F.struct(F.lit("https://openalex.org/C1").alias("id"), F.col("language").alias("display_name"))).alias("concepts"), F.col("citation_count").alias("cited_by_count"),
    )


@of_articles("a3_normalize_openalex", f"SELECT external_id, coalesce(nullif(title, ''), 'Untitled') AS title, 'one two one' AS abstract_text, publish_date, venue AS authors, coalesce(pdf_url, 'https://oa.test') AS pdf_url, coalesce('https://doi.org/' || doi, 'https://openalex.org/' || external_id) AS url, CASE WHEN {FIELD} = primary_category THEN primary_category || ', ' || language ELSE primary_category || ', ' || {FIELD} || ', ' || language END AS categories, doi, venue FROM articles")
def a3(a):
    return S.normalize_openalex(openalex(a)).select("external_id", "title", "abstract_text", "publish_date", "authors", "pdf_url", "url", "categories", "doi", "venue")


@of_articles("a5_is_cs_openalex", "SELECT external_id, primary_category LIKE 'cs.%' AS is_cs FROM articles")
def a5(a):
    return S.normalize_openalex(openalex(a)).select("external_id", F.col("is_computer_science").alias("is_cs"))


@of_articles("a6_normalize_s2", f"SELECT external_id, coalesce(nullif(title, ''), 'Untitled') AS title, abstract_text, publish_date, venue AS authors, pdf_url, {FIELD} AS primary_category, {FIELD} || ', ' || language AS categories, doi, citation_count, venue, primary_category LIKE 'cs.%' AS is_computer_science FROM articles")
def a6(a):
    none = F.lit(None).cast("string")
    papers = a.select(
        F.col("external_id").alias("paperId"), "title", F.col("abstract_text").alias("abstract"), F.date_format("publish_date", "yyyy-MM-dd").alias("publicationDate"), F.array(F.struct(F.col("venue").alias("name")), F.struct(none.alias("name"))).alias("authors"), F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"),
        F.array(F.struct(field().alias("category"))).alias("s2FieldsOfStudy"), F.array(field(), F.col("language")).alias("fieldsOfStudy"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.col("citation_count").alias("citationCount"), F.struct(none.alias("name")).alias("publicationVenue"), F.lit("").alias("venue"), F.struct(F.col("venue").alias("name")).alias("journal"),
    )
    return S.normalize_s2(papers).drop("source")


@query("a22_cluster_catalog", "SELECT cluster_id, cluster_description, article_count FROM clusters ORDER BY cluster_id")
def a22(spark, sf):
    return clusters(spark, sf).select("cluster_id", "cluster_description", "article_count").orderBy("cluster_id")


@of_articles("e12_topic_info", f"{REASSIGN}, i AS (SELECT DISTINCT cluster_id FROM articles WHERE cluster_id >= 0) SELECT cluster_id, count(*) AS article_count FROM i JOIN re ON re.new_cluster_id = i.cluster_id GROUP BY 1".replace("SELECT cluster_id, count(*)", "SELECT i.cluster_id, count(*)"))
def e12(a):
    """Topics with their counts after reassignment; only topics that have documents."""
    info = a.filter("cluster_id >= 0").select("cluster_id").distinct()
    now = E.reassign_outliers(a, 0.2).groupBy(F.col("new_cluster_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("article_count"))
    return info.join(now, "cluster_id").orderBy("cluster_id")


@of_articles("e13_assignment_table", f"WITH {UNIT} SELECT u.id, u.cluster_id, round(list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * c.c[i])), 6) AS probability FROM u LEFT JOIN c USING (cluster_id)")
def e13(a):
    """Each embedded document's topic with its similarity to the topic's centroid as soft membership; null for outliers."""
    j = a.filter("embedding IS NOT NULL").join(V.centroids(a, "cluster_id", "embedding"), "cluster_id", "left")
    return j.select("id", "cluster_id", F.round(V.dot(V.l2_normalize(F.col("embedding")), F.col("centroid")), 6).alias("probability"))


@of_articles("e21_compare_runs", f"{REASSIGN} SELECT 'docs' AS metric, count(*)::DOUBLE AS baseline, count(*)::DOUBLE AS final FROM re UNION ALL SELECT 'outliers', count_if(cluster_id = -1)::DOUBLE, count_if(new_cluster_id = -1)::DOUBLE FROM re UNION ALL SELECT 'topics', count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END)::DOUBLE, count(DISTINCT CASE WHEN new_cluster_id >= 0 THEN new_cluster_id END)::DOUBLE FROM re")
def e21(a):
    """One row a metric: before and after the reassignment of outliers."""
    r = E.reassign_outliers(a, 0.2)
    one = lambda c, run: E.topic_run_summary(r.select(F.col(c).alias("cluster_id"))).select(F.lit(run).alias("run"), *[F.col(m).cast("double") for m in ("docs", "outliers", "topics")])
    long = one("cluster_id", "baseline").unionByName(one("new_cluster_id", "final")).unpivot("run", ["docs", "outliers", "topics"], "metric", "value")
    return long.groupBy("metric").pivot("run", ["baseline", "final"]).agg(F.first("value"))


#: Every article as a question that names some of its own fields.
ASK = "q AS (SELECT id, CASE id % 4 WHEN 0 THEN 'last ' || CAST(id % 90 + 1 AS VARCHAR) || ' days top 7 from ' || source || ' on ' || primary_category WHEN 1 THEN 'newest papers of ' || CAST(2000 + id % 26 AS VARCHAR) || ' with pdf in cluster ' || CAST(id % 10 AS VARCHAR) WHEN 2 THEN '12 papers min ' || CAST(id % 97 AS VARCHAR) || ' citations doi ' || coalesce(doi, 'none') ELSE title END AS text FROM articles)"


def questions(a):
    s, i = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c]), F.col("id")
    n = lambda c: c.cast("string")
    text = F.when(i % 4 == 0, s("last ", n(i % 90 + 1), " days top 7 from ", F.col("source"), " on ", F.col("primary_category"))).when(i % 4 == 1, s("newest papers of ", n(2000 + i % 26), " with pdf in cluster ", n(i % 10))).when(i % 4 == 2, s("12 papers min ", n(i % 97), " citations doi ", F.coalesce("doi", F.lit("none")))).otherwise(F.col("title"))
    return a.select("id", text.alias("text"))


DAY = f"CAST(timestamp '{AS_OF}' AS DATE)"
FACETS = f"""{ASK}, f AS (SELECT id, CASE WHEN contains(lower(text), 'arxiv') THEN 'arxiv' WHEN contains(lower(text), 'openalex') THEN 'openalex' WHEN contains(lower(text), 'semanticscholar') THEN 'semanticscholar' END AS source,
TRY_CAST(nullif(regexp_extract(lower(text), '\\bcluster\\s*(?:id)?\\s*[:#-]?\\s*(\\d+)\\b', 1), '') AS INTEGER) AS cluster_id, CASE WHEN regexp_matches(text, '\\bcs\\.[A-Za-z]{{2}}\\b') THEN 'cs.' || upper(substr(regexp_extract(text, '\\bcs\\.[A-Za-z]{{2}}\\b'), 4, 2)) END AS primary_category,
nullif(regexp_extract(text, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b'), '') AS doi, CASE WHEN contains(lower(text), 'pdf') THEN TRUE END AS has_pdf, TRY_CAST(nullif(regexp_extract(lower(text), '(?:en az|minimum|min|>=)\\s*(\\d+)\\s*(?:citation|citations|atıf)', 1), '') AS INTEGER) AS min_citation_count,
TRY_CAST(nullif(regexp_extract(lower(text), '(?:son|last)\\s+(\\d+)\\s+(?:gün|gun|days?)', 1), '') AS INTEGER) AS days, TRY_CAST(nullif(regexp_extract(lower(text), '\\b(20\\d{{2}}|19\\d{{2}})\\b', 1), '') AS INTEGER) AS year,
coalesce(greatest(1, least(10, coalesce(TRY_CAST(nullif(regexp_extract(lower(text), '\\b(?:top|ilk)\\s+(\\d{{1,2}})\\b', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(lower(text), '\\b(\\d{{1,2}})\\s+(?:makale|paper|papers|article|articles)\\b', 1), '') AS INTEGER)))), 5) AS top_k,
CASE WHEN regexp_matches(lower(text), '\\b(?:latest|newest|most\\s+recent|recent)\\s+(?:papers?|articles?|publications?|studies)\\b') THEN 'publish_date_desc' ELSE 'relevance' END AS sort_by FROM q)"""


@of_articles("g24_extract_filters", f"WITH {FACETS} SELECT id, source, cluster_id, primary_category, doi, has_pdf, min_citation_count, CASE WHEN days IS NOT NULL THEN {DAY} - greatest(1, days) WHEN year IS NOT NULL THEN make_date(year, 1, 1) END AS date_from, CASE WHEN days IS NOT NULL THEN {DAY} WHEN year IS NOT NULL THEN make_date(year, 12, 31) END AS date_to, top_k, sort_by FROM f")
def g24(a):
    return R.extract_filters(questions(a), "text", AS_OF).drop("text", "categories_any")


ROUTE = "(" + " OR ".join([*(f"contains(t, '{k}')" for k in R.KEYWORDS), *(f"regexp_matches(t, '{p}')" for p in R.INTENTS)]) + ")"


@of_articles("g25_route", f"WITH {ASK} SELECT id, {ROUTE} AS use_search FROM (SELECT id, trim(lower(text)) AS t FROM q)")
def g25(a):
    return questions(a).select("id", R.route(F.col("text")).alias("use_search"))


@of_articles("g27_merge_filters", "SELECT id, coalesce(nullif(CASE WHEN id % 2 = 0 THEN '' ELSE source END, ''), 'openalex') AS source, coalesce(citation_count, 5) AS min_citation_count FROM articles")
def g27(a):
    rows = a.select("id", F.struct(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("source")).alias("source"), F.col("citation_count").alias("min_citation_count")).alias("x"), F.struct(F.lit("openalex").alias("source"), F.lit(5).alias("min_citation_count")).alias("y"))
    return R.merge_filters(rows, "x", "y", ("source", "min_citation_count")).drop("x", "y")


@of_articles("i12_rep_scores", f"{REPS} SELECT cluster_id, round(avg(round(score, 6)), 5) AS score FROM rp GROUP BY 1")
def i12(a):
    """Stored scores as a map of texts; values that are no numbers are left out of the mean."""
    text = F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), F.round("score", 6).cast("string"))))
    stored = E.representatives(a).groupBy("cluster_id").agg(text.alias("scores")).withColumn("scores", F.map_concat("scores", F.create_map(F.lit("x"), F.lit("n/a"))))
    rows = stored.select("cluster_id", F.explode("scores").alias("id", "s")).withColumn("s", F.col("s").try_cast("double"))
    return rows.groupBy("cluster_id").agg(F.round(F.avg("s"), 5).alias("score"))


@of_articles("i23_cached_digest", "SELECT cluster_id, language, max(id) AS id FROM articles GROUP BY cluster_id, language")
def i23(a):
    """Latest stored digest of each key; null cluster and null period are keys like others."""
    w = Window.partitionBy("cluster_id", "language").orderBy(F.desc("id"))
    latest = a.select("cluster_id", "language", "id").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    keys = a.select(F.col("cluster_id").alias("c"), F.col("language").alias("l")).distinct()
    return keys.join(latest, F.col("c").eqNullSafe(F.col("cluster_id")) & F.col("l").eqNullSafe(F.col("language"))).drop("c", "l")


@of_articles("i26_article_detail", "SELECT id, title, abstract_text, source, doi, pdf_url, venue, citation_count, publish_date FROM articles")
def i26(a):
    return a.select("id", "title", "abstract_text", "source", "doi", "pdf_url", "venue", "citation_count", "publish_date")


@query("j8_sources_section", "SELECT chat_id, id, CASE WHEN regexp_matches(content, '(?i)(^|\\n)\\s*(?:#+\\s*)?(?:Sources|Kaynaklar)\\b\\s*:?') THEN content ELSE content || chr(10) || chr(10) || 'Sources:' || chr(10) || '[S1] ' || CAST(id AS VARCHAR) END AS content FROM messages WHERE role = 'agent'")
def j8(spark, sf):
    m = messages(spark, sf).filter("role = 'agent'")
    section = F.concat_ws("\n", F.lit("\n\nSources:"), F.concat(F.lit("[S1] "), F.col("id").cast("string")))
    return m.select("chat_id", "id", F.when(EV.answer_signals(F.col("content"))["has_sources_section"], F.col("content")).otherwise(F.concat("content", section)).alias("content"))
