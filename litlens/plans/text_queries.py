"""Registered queries of groups C and U1, and B1/B2/B11."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlens.functions import text as T
from litlens.operators import hygiene as H
from litlens.plans.base import of_articles, query, table

S = r"[\s\p{Z}]+"


def _q(x: str) -> str:
    return x.replace("'", "''")


#: The entities that the texts of the documents may hold, the ampersand last.
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def sql_unescape(c: str) -> str:
    for name, char in COMMON_ENTITIES:
        c = f"replace({c}, '{_q(name)}', '{_q(char)}')"
    return c


def sql_unescape_all(c: str) -> str:
    """All entities: names, beginnings of names, numbers."""
    names, openings = T.entity_tables()
    keys = ", ".join(f"'{_q(k)}'" for k in names)
    values = ", ".join("chr({})".format(") || chr(".join(str(ord(x)) for x in v)) for v in names.values())
    special = {i: x for i in range(160) if (x := T.numbered(i)) is not None}
    odd = " ".join(f"WHEN n = {i} THEN {' || '.join(f'chr({ord(y)})' for y in x) or chr(39) * 2}" for i, x in special.items())
    number = f"CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) {odd} WHEN n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(CAST(n AS INTEGER)) END"
    return f"""(WITH k AS (SELECT map([{keys}], [{values}]) AS names),
pc AS (SELECT page_id, i, p, regexp_extract(p, '{T.REFERENCE}') AS m FROM (SELECT page_id, unnest(string_split({c}, '&')) AS p, unnest(range(len(string_split({c}, '&')))) AS i FROM pages)),
nm AS (SELECT *, CASE WHEN starts_with(lower(m), '#x') THEN TRY_CAST('0x' || ltrim(trim(substr(m, 3), ';'), '0') || CASE WHEN ltrim(trim(substr(m, 3), ';'), '0') = '' THEN '0' ELSE '' END AS BIGINT) WHEN starts_with(m, '#') THEN TRY_CAST(trim(substr(m, 2), ';') AS BIGINT) END AS n, regexp_extract(m, '^({'|'.join(openings)}).', 1) AS b FROM pc),
dc AS (SELECT page_id, i, CASE WHEN i = 0 THEN p WHEN m = '' THEN '&' || p WHEN starts_with(m, '#') THEN {number} || substr(p, length(m) + 1) WHEN names[m] IS NOT NULL THEN names[m] || substr(p, length(m) + 1) WHEN b <> '' THEN names[b] || substr(p, length(b) + 1) ELSE '&' || p END AS t FROM nm, k)
SELECT page_id, string_agg(t, '' ORDER BY i) AS text FROM dc GROUP BY page_id)"""


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{S}', ' ', 'g'))"


def sql_light(c: str) -> str:
    t = f"regexp_replace({sql_unescape(f'''coalesce({c}, '')''')}, '{S}', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '\$+', ' ', 'g'), '\\[a-zA-Z]+', ' ', 'g')"
    return sql_collapse(f"regexp_replace({t}, '[{{}}]', ' ', 'g')")


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{S}'), lambda x: x <> '')"


def sql_boilerplate(c: str) -> str:
    t = f"lower({c})"
    for phrase in T.BOILERPLATE:
        t = rf"regexp_replace({t}, '\b{phrase}\b', ' ', 'g')"
    return sql_collapse(t)


def sql_key(c: str) -> str:
    t = f"regexp_replace(lower({sql_unescape(f'''coalesce({c}, '')''')}), '{S}', ' ', 'g')"
    return sql_collapse(rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')")


def sql_family(c: str) -> str:
    when = " ".join(f"WHEN starts_with(trim(coalesce({c}, '')), '{p}') THEN '{f}'" for f, ps in reversed(T.FAMILIES.items()) for p in ps)
    return f"CASE {when} ELSE 'other' END"


def sql_survey(c: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{t}')" for t in T.SURVEY_TERMS) + ")"


PREPARED = f"""
n AS (SELECT id, source, external_id, primary_category, doi, {sql_light('title')} AS title, {sql_light('abstract_text')} AS abstract,
             external_id AS paper_id, CASE WHEN source = 'arxiv' THEN external_id END AS arxiv_id, language AS lang FROM articles),
k AS (SELECT * FROM n WHERE length(title) > 10 AND length(abstract) > 100),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(arxiv_id), ''), 'none' || id) ORDER BY id) AS r1 FROM k) WHERE r1 = 1),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(doi), ''), 'none' || id) ORDER BY id) AS r2 FROM k1) WHERE r2 = 1),
k3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(paper_id), ''), 'none' || id) ORDER BY id) AS r3 FROM k2) WHERE r3 = 1),
k4 AS (SELECT *, {sql_key('title')} AS title_norm FROM k3),
k5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(title_norm, ''), 'none' || id) ORDER BY id) AS r4 FROM k4) WHERE r4 = 1),
p AS (SELECT *, {sql_light('title')} AS title_clean, {sql_light('abstract')} AS abstract_clean FROM k5),
p2 AS (SELECT * FROM p WHERE length(title_clean) > 10 AND length(abstract_clean) > 100),
f AS (SELECT *, lower(trim(coalesce(lang, 'en'))) AS l, bool_or(length(trim(coalesce(lang, ''))) > 0) OVER () AS filtering FROM p2),
clean AS (SELECT *, len({sql_words('abstract_clean')}) AS abstract_word_count, {sql_survey('title_clean')} AS is_survey, {sql_family('primary_category')} AS category_family FROM f WHERE NOT filtering OR l = 'en')
"""


@of_articles("b1_clean_string", r"SELECT id, nullif(regexp_replace(replace(title, chr(0), ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS title FROM articles")
def b1(a):
    return a.select("id", T.clean_string(F.col("title")).alias("title"))


@of_articles("b2_split_list", "SELECT id, array_to_string(list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items, array_to_string(list_filter(string_split_regex(coalesce(title, ''), '[\\s\\p{Z}]+'), lambda x: x <> ''), '|') AS parts FROM articles")
def b2(a):
    return a.select("id", F.array_join(T.split_list(F.col("categories")), "|").alias("items"), F.array_join(T.split_space(F.col("title")), "|").alias("parts"))


@of_articles("b11_clean_ws", f"SELECT id, nullif({sql_collapse('abstract_text')}, '') AS abstract_text FROM articles")
def b11(a):
    return a.select("id", T.clean_ws(F.col("abstract_text")).alias("abstract_text"))


@of_articles("c1_light_clean", f"SELECT id, {sql_light('abstract_text')} AS abstract_clean FROM articles")
def c1(a):
    return a.select("id", T.light_clean(F.col("abstract_text")).alias("abstract_clean"))


@of_articles("c2_title_key", f"SELECT id, {sql_key('title')} AS title_key FROM articles")
def c2(a):
    return a.select("id", T.title_key(F.col("title")).alias("title_key"))


@of_articles("c3_boilerplate", f"SELECT id, {sql_boilerplate('''coalesce(abstract_text, '')''')} AS text FROM articles")
def c3(a):
    return a.select("id", T.remove_boilerplate(F.col("abstract_text")).alias("text"))


@of_articles("c4_count_words", f"SELECT id, CAST(len({sql_words('''coalesce(abstract_text, '')''')}) AS INTEGER) AS n FROM articles")
def c4(a):
    return a.select("id", T.count_words(F.col("abstract_text")).alias("n"))


@of_articles("c5_truncate_words", f"SELECT id, coalesce(array_to_string(list_slice({sql_words('''coalesce(abstract_text, '')''')}, 1, 250), ' '), '') AS text FROM articles")
def c5(a):
    return a.select("id", T.truncate_words(F.col("abstract_text")).alias("text"))


@of_articles("c6_category_family", f"SELECT id, {sql_family('primary_category')} AS family FROM articles")
def c6(a):
    return a.select("id", T.category_family(F.col("primary_category")).alias("family"))


@of_articles("c7_is_survey", f"SELECT id, {sql_survey('title')} AS is_survey FROM articles")
def c7(a):
    return a.select("id", T.is_survey(F.col("title")).alias("is_survey"))


@of_articles("c8_valid_text", f"SELECT id, length({sql_light('title')}) > 10 AND length({sql_light('abstract_text')}) > 100 AS valid FROM articles")
def c8(a):
    return a.select("id", T.valid_text(F.col("title"), F.col("abstract_text")).alias("valid"))


EMBED = f"trim(concat(t, '. ', t, '. ', coalesce(array_to_string(list_slice({sql_words('a')}, 1, 250), ' '), '')))"
REPR = f"trim(concat(t, '. ', t, '. ', {sql_boilerplate(f'''coalesce(array_to_string(list_slice({sql_words('a')}, 1, 250), ' '), '')''')}))"
LIGHT = f"l AS (SELECT id, {sql_light('title')} AS t, {sql_light('abstract_text')} AS a FROM articles)"


@of_articles("c9_embedding_text", f"WITH {LIGHT} SELECT id, {EMBED} AS text FROM l")
def c9(a):
    return a.select("id", T.embedding_text(F.col("title"), F.col("abstract_text")).alias("text"))


@of_articles("c10_representation_text", f"WITH {LIGHT} SELECT id, {REPR} AS text FROM l")
def c10(a):
    return a.select("id", T.representation_text(F.col("title"), F.col("abstract_text")).alias("text"))


@of_articles("c11_prepare_texts", f"WITH {LIGHT} SELECT id, CAST(len({sql_words('a')}) AS INTEGER) AS abstract_word_count, CAST(length({EMBED}) AS INTEGER) AS embedding_text_len, CAST(length({REPR}) AS INTEGER) AS representation_text_len, {sql_survey('t')} AS is_survey FROM l")
def c11(a):
    return H.prepare_texts(a, "title", "abstract_text").select("id", "abstract_word_count", "embedding_text_len", "representation_text_len", "is_survey")


@of_articles("c12_normalize_records", f"WITH {PREPARED} SELECT id, title, abstract, paper_id, arxiv_id, lang FROM n")
def c12(a):
    return H.normalize_records(a).select("id", "title", "abstract", "paper_id", "arxiv_id", "lang")


@of_articles("c13_split_by_rules", f"WITH {PREPARED} SELECT id, CASE WHEN length(title) <= 10 THEN 'title_too_short_or_empty' ELSE 'abstract_too_short_or_empty' END AS removal_reason FROM n WHERE NOT (length(title) > 10 AND length(abstract) > 100)")
def c13(a):
    return H.split_by_rules(H.normalize_records(a), H.short_reason("title", "abstract", "or_empty"))[1].select("id", "removal_reason")


@of_articles("c14_dedupe_ids", f"WITH {PREPARED} SELECT id, 'kept' AS fate FROM k3 UNION ALL SELECT id, 'duplicate_arxiv_id' FROM k WHERE id NOT IN (SELECT id FROM k1) UNION ALL SELECT id, 'duplicate_doi' FROM k1 WHERE id NOT IN (SELECT id FROM k2) UNION ALL SELECT id, 'duplicate_paper_id' FROM k2 WHERE id NOT IN (SELECT id FROM k3)")
def c14(a):
    kept, dups = H.dedupe_ids(H.keys_of(H.normalize_records(a)).filter("removal_reason IS NULL"))
    return kept.select("id", F.lit("kept").alias("fate")).union(dups.select("id", "duplicate_reason"))


@of_articles("c15_dedupe_titles", f"WITH {PREPARED} SELECT id, title_norm FROM k5")
def c15(a):
    kept, _ = H.dedupe_ids(H.keys_of(H.normalize_records(a)).filter("removal_reason IS NULL"))
    return H.dedupe_titles(kept)[0].select("id", "title_norm")


@of_articles("c16_filter_language", f"WITH {PREPARED} SELECT id, l AS lang, CASE WHEN filtering AND l <> 'en' THEN 'non_english_or_unknown_language' END AS removal_reason FROM (SELECT *, lower(trim(coalesce(lang, 'en'))) AS l, bool_or(length(trim(coalesce(lang, ''))) > 0) OVER () AS filtering FROM n)")
def c16(a):
    kept, gone = H.filter_language(H.normalize_records(a))
    return kept.select("id", "lang", F.lit(None).cast("string").alias("removal_reason")).union(gone.select("id", "lang", "removal_reason"))


@of_articles("c17_hygiene_metrics", f"""WITH {PREPARED}, w AS (SELECT
  (SELECT count(*) FROM n)::DOUBLE AS initial_rows, (SELECT count(*) FROM n WHERE title = '')::DOUBLE AS empty_title_count, (SELECT count(*) FROM n WHERE abstract = '')::DOUBLE AS empty_abstract_count,
  (SELECT count(*) FROM n WHERE length(title) <= 10)::DOUBLE AS short_title_count_len_le_10, (SELECT count(*) FROM n WHERE length(abstract) <= 100)::DOUBLE AS short_abstract_count_len_le_100,
  1.0::DOUBLE AS language_filter_applied, (SELECT count(*) FROM clean)::DOUBLE AS final_rows, (SELECT count(*) FROM clean WHERE title_clean = '')::DOUBLE AS final_empty_title_count, (SELECT count(*) FROM clean WHERE abstract_clean = '')::DOUBLE AS final_empty_abstract_count,
  (SELECT coalesce(avg(length(title_clean)), 0) FROM clean) AS avg_title_length, (SELECT coalesce(avg(length(abstract_clean)), 0) FROM clean) AS avg_abstract_length, (SELECT coalesce(avg(abstract_word_count), 0) FROM clean) AS avg_abstract_word_count,
  (SELECT count(*) FROM clean WHERE is_survey)::DOUBLE AS survey_count, ((SELECT count(*) FROM k) - (SELECT count(*) FROM k5))::DOUBLE AS duplicate_total, ((SELECT count(*) FROM n) - (SELECT count(*) FROM clean))::DOUBLE AS removed_total)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value)""")
def c17(a):
    return H.clean_papers(a).metrics.select("metric", F.round("value", 6).alias("value"))


@of_articles("c18_clean_papers", f"WITH {PREPARED} SELECT id, title_clean, title_norm, CAST(abstract_word_count AS INTEGER) AS abstract_word_count, is_survey, l AS lang, category_family FROM clean")
def c18(a):
    return H.clean_papers(a).clean.select("id", "title_clean", "title_norm", "abstract_word_count", "is_survey", "lang", "category_family")


@of_articles("c19_topic_input", f"WITH {PREPARED} SELECT id, source, external_id, title_clean, primary_category, category_family FROM clean")
def c19(a):
    return H.topic_input(H.clean_papers(a).clean).select("id", "source", "external_id", "title_clean", "primary_category", "category_family")


@query("u1_unescape_pages", f"SELECT page_id, md5(text) AS digest, length(text) AS n FROM {sql_unescape_all('html')}")
def u1_pages(spark, sf):
    """Entities of whole web pages."""
    t = table(spark, sf, "pages").filter("html IS NOT NULL").select("page_id", T.unescape(F.col("html")).alias("text"))
    return t.select("page_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@of_articles("u1_unescape", f"SELECT id, {sql_unescape('title')} AS title FROM articles")
def u1(a):
    return a.select("id", T.unescape(F.col("title")).alias("title"))
