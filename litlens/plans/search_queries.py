"""Registered queries of group G."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from litlens.functions import vectors as V
from litlens.operators import lexicon as L
from litlens.operators import retrieval as R
from litlens.operators import search as G
from litlens.operators import tables as T
from litlens.plans.base import AS_OF, articles, messages, of_articles, query, six, table
from litlens.plans.vector_queries import UNIT

PREDICATES = {
    "source": (G.Filters(source="arxiv"), "source = 'arxiv'"),
    "cluster": (G.Filters(cluster_id=3), "cluster_id = 3"),
    "primary": (G.Filters(primary_category="cs.CL"), "primary_category = 'cs.CL'"),
    "category_any": (G.Filters(categories_any=("cs.AI", "stat.ML")), "(categories ILIKE '%cs.AI%' OR categories ILIKE '%stat.ML%')"),
    "venue": (G.Filters(venue="SRC1"), "venue ILIKE '%SRC1%'"),
    "doi": (G.Filters(doi="1234/1_"), "doi ILIKE '%1234/1_%'"),
    "pdf": (G.Filters(has_pdf=True), "pdf_url IS NOT NULL"),
    "no_pdf": (G.Filters(has_pdf=False), "pdf_url IS NULL"),
    "cited": (G.Filters(min_citation_count=50), "citation_count >= 50"),
    "from": (G.Filters(publish_date_from="2022-01-01"), "publish_date >= timestamp '2022-01-01 00:00:00'"),
    "to": (G.Filters(publish_date_to="2019-06-30"), "publish_date < timestamp '2019-07-01 00:00:00'"),
    "ids": (G.Filters(article_ids=(5, 17, 42)), "id IN (5, 17, 42)"),
}


def _filtered(name, f, cond):
    @of_articles(f"g1_filter_{name}", f"SELECT id, source FROM articles WHERE {cond}")
    def g1(a):
        return a.filter(G.predicate(f)).select("id", "source")


for _name, (_f, _cond) in PREDICATES.items():
    _filtered(_name, _f, _cond)


@of_articles("g2_latest", "SELECT id, publish_date FROM articles WHERE publish_date IS NOT NULL AND source = 'arxiv' ORDER BY publish_date DESC, id DESC LIMIT 25")
def g2(a):
    return G.latest(a, G.Filters(source="arxiv"), 25).select("id", "publish_date")


@of_articles("g3_lookup", "SELECT pos, id, title FROM articles JOIN (SELECT unnest([0, 1, 2]) AS pos, unnest([42, 5, 17]) AS id) USING (id)")
def g3(a):
    ids = a.sparkSession.createDataFrame([(0, 42), (1, 5), (2, 17)], "pos int, id long")
    return G.lookup(a, ids).select("pos", "id", "title")


VEC = f"{UNIT}, vq AS (SELECT c.cluster_id AS query_id, u.id, greatest(0, list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * c.c[i]))) AS score FROM u CROSS JOIN c), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM vq QUALIFY rank <= 25)"


def topic_queries(a):
    """One vector query a topic: its centroid."""
    return V.centroids(a, "cluster_id", "embedding").select(F.col("cluster_id").alias("query_id"), F.col("centroid").alias("vector"))


@of_articles("g4_vector_search", f"WITH {VEC} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vr")
def g4(a):
    return six(G.vector_search(a, topic_queries(a), 25))


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
LEX = f"""lr AS (SELECT id, {TOKENS.format('title')} AS t, {TOKENS.format('abstract_text')} AS a FROM articles WHERE title IS NOT NULL AND abstract_text IS NOT NULL),
le AS (SELECT id, unnest(t) AS term, 1 AS f FROM lr UNION ALL SELECT id, unnest(a), 0 FROM lr),
po AS (SELECT term, id, CAST(sum(f) AS BIGINT) AS tf_title, CAST(sum(1 - f) AS BIGINT) AS tf_abstract FROM le GROUP BY ALL),
ln_ AS (SELECT id, CAST(len(t) + len(a) AS BIGINT) AS length FROM lr), te AS (SELECT term, count(*) AS df FROM po GROUP BY term), tt AS (SELECT count(*) AS n, avg(length) AS avg_length FROM ln_)"""


def index_folder(spark, sf):
    return f"{T.shared_folder(spark)}/lexical-index-{md5(sf.encode()).hexdigest()}"


def index(spark, sf):
    """The stored index of the articles, built by the first query that needs it."""
    return L.opened(articles(spark, sf), index_folder(spark, sf))


@query("g6_index_postings", f"WITH {LEX} SELECT * FROM po")
def g6(spark, sf):
    return L.postings(index(spark, sf))


@query("g6_index_terms", f"WITH {LEX} SELECT * FROM te")
def g6t(spark, sf):
    return index(spark, sf).terms.select("term", "df")


@query("g6_index_lengths", f"WITH {LEX} SELECT id, length FROM ln_ WHERE length > 0")
def g6l(spark, sf):
    return index(spark, sf).blocks.select(F.explode("hits").alias("h")).select("h.id", "h.length").distinct()


@query("g7_index_status", "SELECT 'ok' AS before, 'stale' AS after, 'missing' AS elsewhere, 'articles=' || count(*) || ' embedded=' || count(embedding) || ' max_id=' || max(id) AS fingerprint FROM articles")
def g7(spark, sf):
    """States of the stored index for its articles, for the articles and one more, and of a folder without an index."""
    a, folder = articles(spark, sf), index_folder(spark, sf)
    stored = index(spark, sf)
    more = a.unionByName(a.orderBy("id").limit(1).withColumn("id", F.lit(-1).cast("long")))
    states = [L.status(a, folder), L.status(more, folder), L.status(a, f"{folder}-none")]
    return spark.range(1).select(*[F.lit(x).alias(n) for x, n in zip([*states, stored.fingerprint], ("before", "after", "elsewhere", "fingerprint"), strict=True)])


STOP = "(" + ", ".join(f"'{w}'" for w in G.QUERY_STOP) + ")"


def sql_terms(c: str) -> str:
    tokens = rf"regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}_.\-]{{2,}}')"
    plain = rf"lower(translate(regexp_replace(t, '^[.\-]+|[.\-]+$', '', 'g'), '{G.TURKISH}', '{G.PLAIN}'))"
    kept = f"list_transform(list_filter({tokens}, lambda t: (length({plain}) >= 3 OR (upper(t) = t AND lower(t) <> t)) AND {plain} NOT IN {STOP}), lambda t: {plain})"
    return f"(SELECT list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 8) FROM (SELECT {kept} AS w))"


@query("g8_query_terms", f"SELECT chat_id, id, coalesce(array_to_string({sql_terms('content')}, '|'), '') AS terms FROM messages WHERE role = 'user'")
def g8(spark, sf):
    return messages(spark, sf).filter("role = 'user'").select("chat_id", "id", F.array_join(G.query_terms(F.col("content")), "|").alias("terms"))


BM = f"""{LEX}, qt AS (SELECT item_id AS query_id, unnest({sql_terms('text')}) AS term FROM benchmark),
bs AS (SELECT query_id, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (3.0 * tf_title + tf_abstract) * 2.2 / ((3.0 * tf_title + tf_abstract) + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM qt JOIN po USING (term) JOIN te USING (term) JOIN ln_ USING (id), tt GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bs QUALIFY rank <= 25)"""


def item_terms(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), G.query_terms(F.col("text")).alias("terms"))


@query("g9_bm25_search", f"WITH {BM} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br")
def g9(spark, sf):
    return six(L.search(index(spark, sf), item_terms(spark, sf), 25))


@query("g9_bm25_filtered", f"WITH {BM}, wi AS (SELECT bs.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r, pdf_url FROM bs JOIN articles USING (id) WHERE source = 'arxiv' QUALIFY r <= 40) SELECT query_id, id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM wi WHERE pdf_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 10")
def g9f(spark, sf):
    a = articles(spark, sf)
    return six(L.search_filtered(index(spark, sf), item_terms(spark, sf), a, G.Filters(source="arxiv", has_pdf=True), 10).select("query_id", "id", "score", "rank"))


@of_articles("g11_keyword_score", "SELECT id, round(CAST(3 * len(regexp_extract_all(' ' || regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ', ' the ')) + len(regexp_extract_all(' ' || regexp_replace(lower(coalesce(abstract_text, '')), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ', ' the ')) + CASE WHEN contains(lower(title), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(abstract_text, '')), 'the') THEN 0.25 ELSE 0 END AS DOUBLE), 6) AS score FROM articles")
def g11(a):
    return a.select("id", F.round(G.keyword_score(F.col("title"), F.col("abstract_text"), F.array(F.lit("the"))), 6).alias("score"))


KEY = "coalesce('doi:' || lower(trim(doi)), 'external:' || source || ':' || external_id)"


@of_articles("g12_identity_key", f"SELECT id, {KEY} AS key FROM articles")
def g12(a):
    return a.select("id", G.identity_key().alias("key"))


#: Both retrievers for the same queries: a topic's centroid, and the words of its first title.
FUSE = f"""{VEC}, {LEX}, q0 AS (SELECT cluster_id AS query_id, arg_min(title, id) AS text FROM articles WHERE cluster_id >= 0 GROUP BY 1), qt AS (SELECT query_id, unnest({sql_terms('text')}) AS term FROM q0),
bs AS (SELECT query_id, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (3.0 * tf_title + tf_abstract) * 2.2 / ((3.0 * tf_title + tf_abstract) + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM qt JOIN po USING (term) JOIN te USING (term) JOIN ln_ USING (id), tt GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bs QUALIFY rank <= 25),
ky AS (SELECT id, {KEY} AS key FROM articles),
v1 AS (SELECT query_id, key, arg_min(id, rank) AS vid, max(rank) AS vector_rank, arg_max(score, rank) AS vector_score FROM vr JOIN ky USING (id) GROUP BY 1, 2),
b1 AS (SELECT query_id, key, arg_min(id, rank) AS bid, max(rank) AS bm25_rank, arg_max(score, rank) AS bm25_score FROM br JOIN ky USING (id) GROUP BY 1, 2),
mg AS (SELECT query_id, key, coalesce(vid, bid) AS id, vector_rank, vector_score, bm25_rank, bm25_score, CASE WHEN vid IS NOT NULL AND bid IS NOT NULL THEN 'both' WHEN vid IS NOT NULL THEN 'vector' ELSE 'bm25' END AS retrieval_source FROM v1 FULL JOIN b1 USING (query_id, key))"""


def title_hits(spark, sf, n=25):
    """BM25 hits of each topic's first title."""
    first = articles(spark, sf).filter("cluster_id >= 0").groupBy(F.col("cluster_id").alias("query_id")).agg(F.min_by("title", "id").alias("text"))
    return L.search(index(spark, sf), first.select("query_id", G.query_terms(F.col("text")).alias("terms")), n)


def merged(spark, sf):
    a = articles(spark, sf)
    keyed = lambda df: df.join(a.select("id", G.identity_key().alias("key")), "id")
    return G.merge_candidates(keyed(G.vector_search(a, topic_queries(a), 25)), keyed(title_hits(spark, sf)))


@query("g13_merge_candidates", f"WITH {FUSE} SELECT query_id, id, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank, retrieval_source FROM mg")
def g13(spark, sf):
    return merged(spark, sf).select("query_id", "id", "vector_rank", "bm25_rank", "retrieval_source")


ORDER = "round(fusion_score, 9) DESC, round(coalesce(vector_score, 0), 9) DESC, round(coalesce(bm25_score, 0), 9) DESC, id"


@query("g14_rrf", f"WITH {FUSE}, f AS (SELECT *, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS fusion_score FROM mg) SELECT query_id, id, round(fusion_score, 6) AS fusion_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS INTEGER) AS fusion_rank FROM f")
def g14(spark, sf):
    return six(G.fuse_rrf(merged(spark, sf)).select("query_id", "id", "fusion_score", "fusion_rank"))


def _mm(c: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN max({c}) {w} = min({c}) {w} THEN 1 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"


@query("g15_weighted", f"WITH {FUSE}, f AS (SELECT *, 0.65 * {_mm('vector_score')} + 0.35 * {_mm('bm25_score')} AS fusion_score FROM mg) SELECT query_id, id, round(fusion_score, 6) AS fusion_score FROM f")
def g15(spark, sf):
    return six(G.fuse_weighted(merged(spark, sf)).select("query_id", "id", "fusion_score"))


FINAL = f"""0.5 + CASE WHEN publish_date IS NOT NULL THEN greatest(0, 0.05 * (1 - least(greatest(0, floor((epoch(timestamp '{AS_OF}') - epoch(publish_date)) / 86400)), 365) / 365)) ELSE 0 END
 + CASE WHEN citation_count > 0 THEN least(0.03, log10(citation_count + 1) / 100) ELSE 0 END - CASE WHEN trim(coalesce(abstract_text, '')) = '' THEN 0.05 ELSE 0 END"""


@of_articles("g16_final_score", f"SELECT id, round({FINAL}, 6) AS score FROM articles")
def g16(a):
    return a.select("id", F.round(G.final_score(F.lit(0.5), AS_OF), 6).alias("score"))


@of_articles("g17_keyword_component", "SELECT id, round(CASE WHEN citation_count > 0 THEN least(0.65, ln(1 + citation_count) / 5) ELSE 0 END, 6) AS score FROM articles")
def g17(a):
    return a.select("id", F.round(G.keyword_component(F.col("citation_count").cast("double")), 6).alias("score"))


@of_articles("g18_dedupe_best", f"SELECT id FROM (SELECT *, {KEY} AS key, {FINAL} AS s FROM articles) QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(s, 9) DESC, id) = 1")
def g18(a):
    return G.dedupe_best(a.withColumn("s", G.final_score(F.lit(0.5), AS_OF)), "s").select("id")


@of_articles("g19_dedupe_first", f"SELECT id FROM (SELECT *, {KEY} AS key FROM articles) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1")
def g19(a):
    return G.dedupe_first(a).select("id")


@of_articles("g21_format_results", f"WITH {VEC} SELECT query_id, 'S' || CAST(rank AS VARCHAR) AS source_id, id AS article_id FROM vr WHERE rank <= 5")
def g21(a):
    return G.vector_search(a, topic_queries(a), 5).select("query_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"), F.col("id").alias("article_id"))


SHOWN = r"regexp_replace(coalesce(abstract_text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
CONTEXT = " || chr(10) || ".join(("'[S' || CAST(rank AS VARCHAR) || ']'", "'article_id: ' || CAST(id AS VARCHAR)", "'title: ' || title", "'authors: ' || CASE WHEN id % 2 = 0 THEN 'Ann, Bo' ELSE 'Unknown' END", "'source: ' || source", "'external_id: ' || external_id", "'venue: ' || venue", "'publish_date: ' || coalesce(strftime(publish_date, '%Y-%m-%dT%H:%M:%S'), 'Unknown')", "'doi: ' || coalesce(doi, 'None')", "'url: ' || coalesce(pdf_url, 'None')", "'cluster_id: ' || coalesce(CAST(cluster_id AS VARCHAR), 'None')", "'category: ' || primary_category", "'citation_count: ' || coalesce(CAST(citation_count AS VARCHAR), 'Unknown')", "'score: ' || printf('%.4f', score)", f"'abstract: ' || coalesce(nullif(CASE WHEN length({SHOWN}) > 1200 THEN substr({SHOWN}, 1, 1200) || '...' ELSE {SHOWN} END, ''), 'No abstract available.')"))


@of_articles("g22_context_text", f"WITH {VEC} SELECT query_id, string_agg({CONTEXT}, chr(10) || chr(10) ORDER BY rank) AS context FROM vr JOIN articles USING (id) WHERE rank <= 5 GROUP BY query_id")
def g22(a):
    return R.context_text(G.vector_search(a, topic_queries(a), 5), a.withColumn("authors", F.when(F.col("id") % 2 == 0, "Ann, Bo")))


@of_articles("g28_normalize_decision", "SELECT id, greatest(1, least(10, citation_count)) AS top_k, CASE WHEN language IN ('relevance', 'publish_date_desc') THEN language ELSE 'relevance' END AS sort_by, lower(source) AS source FROM articles WHERE citation_count IS NOT NULL")
def g28(a):
    return G.normalize_decision(a.filter("citation_count IS NOT NULL").select("id", F.col("citation_count").alias("top_k"), F.col("language").alias("sort_by"), "source"))
