"""Registered queries of groups A and B."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlens.functions import text as T
from litlens.operators import ingest as B
from litlens.plans.base import AS_OF, of_articles

LIST = "list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)), lambda x: x <> '')"
VALUES = f"list_transform(list_concat([coalesce(primary_category, '')], {LIST}), lambda c: lower(trim(c)))"
IS_CS = f"CASE WHEN lower(source) = 'arxiv' THEN len(list_filter({VALUES}, lambda c: starts_with(c, 'cs.'))) > 0 ELSE len(list_filter({VALUES}, lambda c: c IN ('computer science', 'cs'))) > 0 END"


@of_articles("b3_is_cs", f"SELECT id, {IS_CS} AS is_cs FROM articles")
def b3(a):
    return a.select("id", B.is_cs().alias("is_cs"))


@of_articles("b4_cluster_scope", r"SELECT id, regexp_matches(coalesce(primary_category, '') || ',' || coalesce(categories, ''), '(^|[,\s])cs\.[A-Za-z]{2}($|[,\s])') AS in_scope FROM articles")
def b4(a):
    return a.select("id", B.in_cluster_scope().alias("in_scope"))


@of_articles("b5_cs_only", "SELECT id FROM articles WHERE primary_category ILIKE 'cs.%' OR categories ILIKE '%cs.%'")
def b5(a):
    return a.filter(B.cs_only()).select("id")


@of_articles("b6_cap_lengths", "SELECT id, CASE WHEN length(title) > 500 THEN substr(title, 1, 497) || '...' ELSE title END AS title, substr(language, 1, 20) AS language FROM articles")
def b6(a):
    return B.cap_lengths(a).select("id", "title", "language")


@of_articles("b7_metadata", f"SELECT id, CAST(year(publish_date) AS INTEGER) AS publish_year, CAST(month(publish_date) AS INTEGER) AS publish_month, array_to_string({LIST}, '|') AS categories_list, coalesce(pdf_url <> '', FALSE) AS has_pdf, coalesce(language, 'en') AS language, 'Ann ' || CAST(id AS VARCHAR) || '|Bo' AS authors_list, CASE WHEN id % 2 = 0 THEN 'v2' ELSE 'v1' END AS source_payload_version, '{AS_OF}' AS metadata_normalized_at, 'note=' || venue AS carried FROM articles")
def b7(a):
    """With authors and an incoming map, of which one key is the payload, one a derived field, and in half of the rows a version."""
    some = F.map_from_arrays(F.array(F.lit("note"), F.lit("ingestion_source_payload"), F.lit("source")), F.array(F.col("venue"), F.lit("{}"), F.lit("old")))
    rows = a.withColumns({"authors": F.concat(F.lit("Ann "), F.col("id").cast("string"), F.lit(", , Bo")), "metadata_json": F.when(F.col("id") % 2 == 0, F.map_concat(some, F.create_map(F.lit("source_payload_version"), F.lit("v2")))).otherwise(some)})
    m = rows.select("id", B.build_metadata(rows, "run-1", AS_OF).alias("m"))
    carried = F.array_join(F.transform(F.map_entries("m.carried"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("id", "m.publish_year", "m.publish_month", F.array_join("m.categories_list", "|").alias("categories_list"), "m.has_pdf", "m.language", F.array_join("m.authors_list", "|").alias("authors_list"), "m.source_payload_version", "m.metadata_normalized_at", carried.alias("carried"))


@of_articles("b8_article_row", r"SELECT id, nullif(regexp_replace(CASE WHEN length(title) > 500 THEN substr(title, 1, 497) || '...' ELSE title END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS title, 'article' AS document_type, 'run-1' AS ingestion_run_id FROM articles")
def b8(a):
    return B.to_article_row(a, "run-1", AS_OF).select("id", "title", "document_type", "ingestion_run_id")


@of_articles("b9_complete", "SELECT id FROM articles WHERE source <> '' AND external_id <> '' AND title <> '' AND abstract_text <> ''")
def b9(a):
    return B.complete(a).select("id")


@of_articles("b10_dedupe_last", "SELECT max(id) AS id, external_id, min(id) AS position FROM articles GROUP BY external_id")
def b10(a):
    return B.dedupe_last(a, "external_id", "id").select("id", "external_id", F.col("_position").alias("position"))


@of_articles("b12_parse_date", "SELECT id, publish_date AS from_rfc, publish_date AS from_iso, publish_date AS from_z, CAST(NULL AS TIMESTAMP) AS from_junk FROM articles")
def b12(a):
    d = F.col("publish_date")
    return a.select("id", B.parse_date(F.date_format(d, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).alias("from_rfc"), B.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("from_iso"), B.parse_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("from_z"), B.parse_date(F.col("title")).alias("from_junk"))


@of_articles("b13_first_version_date", "SELECT id, publish_date AS first_date FROM articles")
def b13(a):
    v = F.array(F.struct(F.lit("v0").alias("version"), F.lit("no date").alias("created")), F.struct(F.lit("v1").alias("version"), F.date_format("publish_date", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("created")))
    return a.select("id", B.first_version_date(v).alias("first_date"))


@of_articles("b14_normalize_doi", "SELECT id, doi FROM articles")
def b14(a):
    return a.select("id", B.normalize_doi(F.concat(F.lit("https://doi.org/"), F.col("doi"))).alias("doi"))


@of_articles("b15_supported_date", "SELECT id, coalesce(publish_date >= timestamp '2018-01-01 00:00:00', TRUE) AS supported FROM articles")
def b15(a):
    return a.select("id", B.supported_date(F.col("publish_date"), "2018-01-01").alias("supported"))


CAND = f"cd AS (SELECT * FROM articles WHERE source <> '' AND external_id <> '' AND title <> '' AND abstract_text <> '' AND year(publish_date) BETWEEN 2016 AND 2026 AND (doi IS NOT NULL OR pdf_url IS NOT NULL) AND {IS_CS})"


@of_articles("b16_candidates", f"WITH {CAND} SELECT id FROM cd")
def b16(a):
    return B.sampling_candidates(a, 2016, 2026).select("id")


SAMPLE = f"{CAND}, sm AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY strftime(publish_date, '%Y-%m') ORDER BY md5('42-' || CAST(id AS VARCHAR)), id) <= 2)"


@of_articles("b17_sample_per_month", f"WITH {SAMPLE} SELECT id FROM sm")
def b17(a):
    return B.sample_per_month(B.sampling_candidates(a, 2016, 2026), 2, "42").select("id")


@of_articles("b18_cap_sample", f"WITH {SAMPLE} SELECT id FROM sm ORDER BY md5('42-' || CAST(id AS VARCHAR)), id LIMIT 50")
def b18(a):
    return B.cap_sample(B.sample_per_month(B.sampling_candidates(a, 2016, 2026), 2, "42"), 50, "42").select("id")


@of_articles("b19_month_coverage", f"WITH {SAMPLE}, mo AS (SELECT strftime(unnest(generate_series(timestamp '2016-01-01 00:00:00', timestamp '2026-12-01 00:00:00', INTERVAL 1 MONTH)), '%Y-%m') AS month) SELECT month, count(id) AS n, count(id) < 2 AS underfilled FROM mo LEFT JOIN sm ON strftime(sm.publish_date, '%Y-%m') = month GROUP BY month")
def b19(a):
    return B.month_coverage(B.sample_per_month(B.sampling_candidates(a, 2016, 2026), 2, "42"), 2016, 2026, 2)


@of_articles("b20_ingest_stats", f"WITH {CAND} SELECT (SELECT count(*) FROM articles) AS raw, (SELECT count(title) FROM articles) AS parsed, (SELECT count(*) FROM cd) AS eligible")
def b20(a):
    n = a.agg(F.count(F.lit(1)).alias("raw"), F.count("title").alias("parsed"))
    return n.crossJoin(B.sampling_candidates(a, 2016, 2026).agg(F.count(F.lit(1)).alias("eligible")))


@of_articles("b21_sample_with_fallback", "SELECT id FROM articles ORDER BY embedding IS NULL, md5('7-' || CAST(id AS VARCHAR)), id LIMIT 600")
def b21(a):
    return B.sample_with_fallback(a, 600, "7").select("id")


@of_articles("b22_slices", "SELECT id, title IS NOT NULL AND abstract_text IS NOT NULL AS with_text, embedding IS NOT NULL AS embedded, title IS NOT NULL AND abstract_text IS NOT NULL AND embedding IS NULL AS pending FROM articles")
def b22(a):
    text = F.col("title").isNotNull() & F.col("abstract_text").isNotNull()
    return a.select("id", text.alias("with_text"), F.col("embedding").isNotNull().alias("embedded"), (text & F.col("embedding").isNull()).alias("pending"))


WORDS = r"list_filter(regexp_split_to_array({}, '[\s\p{{Z}}]+'), lambda x: x <> '')"
COLLAPSED = r"nullif(trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g')), '')"


@of_articles("a2_normalize_dump", f"SELECT external_id, {COLLAPSED.format('title')} AS title, {COLLAPSED.format('abstract_text')} AS abstract_text, publish_date, 'https://arxiv.org/abs/' || external_id AS url, primary_category, primary_category || ', math.CO' AS categories, starts_with(primary_category, 'cs.') AS is_computer_science FROM articles WHERE {COLLAPSED.format('title')} IS NOT NULL")
def a2(a):
    when = F.date_format("publish_date", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    rec = a.select(F.col("external_id").alias("id"), "title", F.col("abstract_text").alias("abstract"), F.concat(F.col("primary_category"), F.lit("  math.CO")).alias("categories"), F.array(F.struct(F.lit("v1").alias("version"), when.alias("created"))).alias("versions"), F.date_format("publish_date", "yyyy-MM-dd").alias("update_date"), "doi", F.col("venue").alias("journal_ref"))
    return B.normalize_dump(rec).select("external_id", "title", "abstract_text", "publish_date", "url", "primary_category", "categories", "is_computer_science")


@of_articles("a4_reconstruct_abstract", f"SELECT id, nullif(array_to_string({WORDS.format('title')}, ' '), '') AS text FROM articles")
def a4(a):
    w = T.words(F.col("title"))
    places = F.map_from_entries(F.transform(F.array_distinct(w), lambda x: F.struct(x, F.filter(F.transform(w, lambda y, i: F.when(y == x, i)), lambda p: p.isNotNull()))))
    return a.select("id", B.reconstruct_abstract(places).alias("text"))


@of_articles("a12_write_vectors", "SELECT id, coalesce(cluster_id = 3, FALSE) AS matched, embedding IS NOT NULL AS has_vector FROM articles")
def a12(a):
    new = a.filter("cluster_id = 3").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return B.write_vectors(a, new).select("id", "matched", F.col("embedding").isNotNull().alias("has_vector"))


@of_articles("a13_load_records", "SELECT id, title FROM articles WHERE source = 'arxiv' AND (primary_category ILIKE 'cs.%' OR categories ILIKE '%cs.%') ORDER BY id LIMIT 100")
def a13(a):
    return a.filter((F.col("source") == "arxiv") & B.cs_only()).select("id", "title").orderBy("id").limit(100)


@of_articles("a17_upsert", "WITH t AS (SELECT external_id, arg_min(doi, id) AS doi, arg_min(citation_count, id) AS citation_count, arg_min(language, id) AS language, min(id) AS k FROM (SELECT id, external_id, coalesce(doi, '') AS doi, coalesce(citation_count, -1) AS citation_count, language FROM articles) GROUP BY 1) SELECT external_id, nullif(doi, '') AS doi, CASE WHEN citation_count = -1 THEN NULL WHEN citation_count > 50 THEN citation_count + 1 ELSE citation_count END AS citation_count, CASE WHEN citation_count > 50 THEN 'xx' ELSE language END AS language FROM t")
def a17(a):
    target = a.groupBy("external_id").agg(F.min_by(F.struct("doi", "citation_count", "language"), "id").alias("r")).select("external_id", "r.doi", "r.citation_count", "r.language")
    batch = target.filter("citation_count > 50").select("external_id", F.lit(None).cast("string").alias("doi"), (F.col("citation_count") + 1).alias("citation_count"), F.lit("xx").alias("language"))
    return B.upsert_articles(target, batch)


@of_articles("a18_validate", "SELECT 'duplicate_keys' AS check, count(*) AS value FROM (SELECT 1 FROM articles GROUP BY external_id HAVING count(*) > 1) UNION ALL SELECT 'missing_columns', 0")
def a18(a):
    return B.validate_articles(a)
