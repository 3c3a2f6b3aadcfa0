"""Registered queries of groups D and E."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlens.functions import text as T
from litlens.functions import vectors as V
from litlens.operators import topics as E
from litlens.plans.text_queries import EMBED, LIGHT, REPR
from litlens.plans.base import of_articles

NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
UNIT = f"""
d AS (SELECT *, embedding::DOUBLE[] AS dv FROM articles WHERE embedding IS NOT NULL),
nn AS (SELECT *, {NORM.format(v='dv')} AS nrm FROM d),
u AS (SELECT *, CASE WHEN nrm = 0 THEN dv ELSE list_transform(dv, lambda x: x / nrm) END AS v FROM nn),
ux AS (SELECT cluster_id, unnest(v) AS val, unnest(dv) AS raw, unnest(range(1, len(v) + 1)) AS pos FROM u WHERE cluster_id >= 0),
cm AS (SELECT cluster_id, pos, avg(val) AS m, avg(raw) AS rm FROM ux GROUP BY ALL),
c0 AS (SELECT cluster_id, list(m ORDER BY pos) AS m, list(rm ORDER BY pos) AS rm FROM cm GROUP BY cluster_id),
c AS (SELECT cluster_id, rm, list_transform(m, lambda x: x / n) AS c FROM (SELECT *, {NORM.format(v='m')} AS n FROM c0))
"""


@of_articles("d1_prefixed_text", "SELECT id, CASE WHEN starts_with(lower(trim(title)), 'passage:') THEN trim(title) ELSE 'passage: ' || trim(title) END AS passage, CASE WHEN starts_with(lower(trim(title)), 'query:') THEN trim(title) ELSE 'query: ' || trim(title) END AS query FROM articles")
def d1(a):
    return a.select("id", V.passage_text(F.col("title")).alias("passage"), V.query_text(F.col("title")).alias("query"))


@of_articles("d2_text_hash", "SELECT id, sha256(title) AS hash FROM articles")
def d2(a):
    return a.select("id", V.text_hash(F.col("title")).alias("hash"))


def pending_embeddings(articles, texts, model: str):
    """D3: ids whose vector is missing, of another model, or of another text."""
    j = texts.join(articles, "id", "left")
    fresh = F.col("embedding").isNotNull() & F.col("model").eqNullSafe(F.lit(model)) & F.col("stored_hash").eqNullSafe(F.col("hash"))
    return j.filter(~fresh).select("id", "hash")


def embedded_hash():
    """The hash of the text that is embedded: cleaned title and abstract."""
    return V.text_hash(V.passage_text(T.embedding_text(F.col("title"), F.col("abstract_text"))))


@of_articles("d3_pending_embeddings", f"WITH {LIGHT}, e AS (SELECT id, {EMBED} AS text FROM l) SELECT id, sha256(CASE WHEN starts_with(lower(text), 'passage:') THEN text ELSE 'passage: ' || text END) AS hash FROM e JOIN articles USING (id) WHERE embedding IS NULL OR language = 'de' OR citation_count IS NULL")
def d3(a):
    stored = a.select("id", "embedding", F.when(F.col("language") == "de", "old-model").otherwise("encoder-1").alias("model"), F.when(F.col("citation_count").isNull(), "stale").otherwise(embedded_hash()).alias("stored_hash"))
    return pending_embeddings(stored, a.select("id", embedded_hash().alias("hash")), "encoder-1")


@of_articles("d6_cosine", f"WITH {UNIT} SELECT a.id, round(list_cosine_similarity(a.dv, c.rm), 6) AS similarity FROM d a JOIN c USING (cluster_id)")
def d6(a):
    return a.filter("embedding IS NOT NULL").join(V.centroids(a, "cluster_id", "embedding", False), "cluster_id").select("id", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


@of_articles("d7_l2_normalize", f"WITH {UNIT} SELECT id, round(list_sum(v), 6) AS total, round({NORM.format(v='v')}, 6) AS norm FROM u")
def d7(a):
    v = a.filter("embedding IS NOT NULL").select("id", V.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@of_articles("d8_valid_vector", "SELECT id, embedding IS NOT NULL AND len(embedding) > 0 AS valid FROM articles")
def d8(a):
    return a.select("id", V.valid_vector(V.parse_vector(F.to_json("embedding"))).alias("valid"))


@of_articles("d9_topic_corpus", "SELECT count(*) AS articles, count_if(embedding IS NOT NULL AND citation_count IS NOT NULL) AS usable, count_if(embedding IS NOT NULL AND citation_count IS NULL) AS stale FROM articles")
def d9(a):
    stored = a.select("id", "embedding", F.when(F.col("citation_count").isNull(), "stale").otherwise(embedded_hash()).alias("stored_hash"))
    j = a.select("id", embedded_hash().alias("hash")).join(stored, "id")
    has, same = F.col("embedding").isNotNull(), F.col("hash") == F.col("stored_hash")
    return j.agg(F.count(F.lit(1)).alias("articles"), F.count_if(has & same).alias("usable"), F.count_if(has & ~same).alias("stale"))


@of_articles("e3_min_samples", "SELECT id, CAST(greatest(5, least(15, coalesce(citation_count, 0) // 5)) AS INTEGER) AS min_samples FROM articles")
def e3(a):
    return a.select("id", E.default_min_samples(F.coalesce("citation_count", F.lit(0))).alias("min_samples"))


STOP = "(" + ", ".join(f"'{w}'" for w in E.STOP_WORDS) + ")"
BAD = "(" + ", ".join(f"'{w}'" for w in (*E.STOP_WORDS, *E.GENERIC_WORDS)) + ")"
TERMS = rf"""
{LIGHT}, rt AS (SELECT id, {REPR} AS text FROM l), tk AS (SELECT id, cluster_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN {STOP}) AS w FROM articles JOIN rt USING (id) WHERE cluster_id >= 0),
tm AS (SELECT id, cluster_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tk),
pd AS (SELECT id, cluster_id, term, count(*) AS n FROM tm GROUP BY ALL),
tt AS (SELECT cluster_id, term, sum(n)::BIGINT AS tf, count(*) AS docs FROM pd GROUP BY ALL),
tf AS (SELECT cluster_id, term, tf FROM (SELECT *, sum(docs) OVER (PARTITION BY term) AS df FROM tt) WHERE df >= 2),
cw AS (SELECT cluster_id, term, sqrt(tf / sum(tf) OVER (PARTITION BY cluster_id)) * ln(1 + (SELECT sum(tf) / count(DISTINCT cluster_id) FROM tf) / sum(tf) OVER (PARTITION BY term)) AS weight FROM tf),
kw AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, term) AS rank FROM cw QUALIFY rank <= 10)
"""


@of_articles("e4_topic_terms", f"WITH {TERMS} SELECT cluster_id, term, tf FROM tf")
def e4(a):
    return E.topic_terms(a)


@of_articles("e5_ctfidf", f"WITH {TERMS} SELECT cluster_id, term, round(weight, 6) AS weight FROM cw")
def e5(a):
    return E.ctfidf(E.topic_terms(a)).withColumn("weight", F.round("weight", 6))


@of_articles("e6_topic_keywords", f"WITH {TERMS} SELECT cluster_id, term, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM kw")
def e6(a):
    return E.topic_keywords(E.ctfidf(E.topic_terms(a))).select("cluster_id", "term", "rank", F.round("weight", 6).alias("weight"))


REASSIGN = f"""WITH {UNIT}, s AS (SELECT u.id, c.cluster_id AS k, list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * c.c[i])) AS s FROM u CROSS JOIN c WHERE u.cluster_id = -1),
b AS (SELECT id, k, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k) AS r FROM s) WHERE r = 1),
re AS (SELECT u.id, u.cluster_id, CASE WHEN b.s >= 0.2 THEN b.k ELSE u.cluster_id END AS new_cluster_id FROM u LEFT JOIN b USING (id))"""


@of_articles("e7_reassign_outliers", f"{REASSIGN} SELECT id, cluster_id, CAST(new_cluster_id AS INTEGER) AS new_cluster_id FROM re")
def e7(a):
    return E.reassign_outliers(a, 0.2).select("id", "cluster_id", "new_cluster_id")


@of_articles("e7_reassignment_counts", f"{REASSIGN} SELECT count_if(cluster_id = -1) AS outliers_before, count_if(new_cluster_id = -1) AS outliers_after, count_if(cluster_id = -1) - count_if(new_cluster_id = -1) AS reassigned, round((count_if(cluster_id = -1) - count_if(new_cluster_id = -1)) / count_if(cluster_id = -1), 6) AS acceptance FROM re")
def e7b(a):
    return E.reassignment_counts(E.reassign_outliers(a, 0.2)).withColumn("acceptance", F.round("acceptance", 6))


@of_articles("e8_centroids", f"WITH {UNIT} SELECT cluster_id, unnest(range(0, len(c))) AS pos, round(unnest(c), 6) AS val FROM c")
def e8(a):
    return V.centroids(a, "cluster_id", "embedding").select("cluster_id", F.posexplode("centroid").alias("pos", "val")).select("cluster_id", F.col("pos").cast("long").alias("pos"), F.round("val", 6).alias("val"))


@of_articles("e9_merge_clusters", f"""WITH RECURSIVE {UNIT}, nb AS (SELECT a.cluster_id AS a, b.cluster_id AS b FROM c a JOIN c b ON a.cluster_id <> b.cluster_id WHERE list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) >= 0.25),
reach AS (SELECT cluster_id AS a, cluster_id AS b FROM c UNION SELECT reach.a, nb.b FROM reach JOIN nb ON nb.a = reach.b) SELECT a AS cluster_id, min(b) AS merged_id FROM reach GROUP BY a""")
def e9(a):
    return E.merge_mapping(a, 0.25)


@of_articles("e10_largest_ratio", "SELECT max(n) / sum(n) AS largest_cluster_ratio FROM (SELECT count(*) AS n FROM articles WHERE cluster_id >= 0 GROUP BY cluster_id)")
def e10(a):
    return E.largest_cluster_ratio(a)


@of_articles("e11_run_summary", "SELECT count(*) AS docs, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS topics, count_if(cluster_id = -1) AS outliers, round(count_if(cluster_id = -1) / count(*), 6) AS outlier_ratio, (SELECT max(n) FROM (SELECT count(*) AS n FROM articles WHERE cluster_id >= 0 GROUP BY cluster_id)) AS largest, round((SELECT max(n) FROM (SELECT count(*) AS n FROM articles WHERE cluster_id >= 0 GROUP BY cluster_id)) / count_if(cluster_id >= 0), 6) AS largest_ratio FROM articles WHERE cluster_id IS NOT NULL")
def e11(a):
    return E.topic_run_summary(a)


@of_articles("e14_clean_keywords", f"""SELECT id, array_to_string(list_distinct_ordered, '|') AS words FROM (SELECT id, list_filter(w, lambda x, i: x <> '' AND x NOT IN {BAD} AND list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT id, string_split(lower(title), ' ') AS w FROM articles))""")
def e14(a):
    return a.select("id", F.array_join(E.clean_keywords(F.split("title", " ")), "|").alias("words"))


@of_articles("e15_valid_topic", f"SELECT id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN {STOP})) / len(w) <= 0.5 ELSE FALSE END AS valid FROM (SELECT id, list_slice(string_split(lower(title), ' '), 1, 10) AS w FROM articles)")
def e15(a):
    return a.select("id", E.valid_topic(F.split(F.lower("title"), " ")).alias("valid"))


REPS = f"WITH {UNIT}, sc AS (SELECT a.cluster_id, a.id, list_cosine_similarity(a.dv, c.rm) AS score FROM d a JOIN c USING (cluster_id)), rp AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 10)"


@of_articles("e16_representatives", f"{REPS} SELECT cluster_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM rp")
def e16(a):
    return E.representatives(a).select("cluster_id", "id", "rank", F.round("score", 6).alias("score"))


@of_articles("e17_cluster_profile", f"""{REPS}, cn AS (SELECT cluster_id, primary_category AS category, count(*) AS n FROM articles WHERE cluster_id >= 0 GROUP BY cluster_id, primary_category), ct AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, category) AS rank FROM cn QUALIFY rank <= 5)
SELECT a.cluster_id, count(*) AS article_count, min(publish_date) AS first_date, max(publish_date) AS last_date, count_if(source = 'arxiv') AS n_arxiv, count_if(source = 'openalex') AS n_openalex, count_if(source = 'semanticscholar') AS n_semanticscholar,
(SELECT string_agg(category, ', ' ORDER BY rank) FROM ct WHERE ct.cluster_id = a.cluster_id) AS categories, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FROM rp WHERE rp.cluster_id = a.cluster_id) AS representative_ids FROM articles a WHERE cluster_id >= 0 GROUP BY a.cluster_id""")
def e17(a):
    return E.cluster_profile(a).withColumn("representative_ids", F.array_join(F.col("representative_ids").cast("array<string>"), ","))


@of_articles("e18_build_clusters", f"""WITH {TERMS}, g AS (SELECT cluster_id, list(term ORDER BY rank) AS raw FROM kw GROUP BY cluster_id),
cl AS (SELECT cluster_id, list_filter(raw, lambda x: x NOT IN {BAD} AND len(list_filter(string_split(x, ' '), lambda p: p NOT IN {BAD})) > 0) AS k FROM g)
SELECT cluster_id, array_to_string(k, ', ') AS name, article_count FROM cl JOIN (SELECT cluster_id, count(*) AS article_count FROM articles WHERE cluster_id >= 0 GROUP BY 1) USING (cluster_id) WHERE len(k) > 0""")
def e18(a):
    return E.build_clusters(a).drop("keywords")


@of_articles("a20_publish_clusters", "SELECT id, CAST(nullif(cluster_id, -1) AS INTEGER) AS cluster_id FROM articles")
def a20(a):
    assign = a.filter("cluster_id IS NOT NULL").select("id", F.nullif("cluster_id", F.lit(-1)).alias("cluster_id"))
    return a.drop("cluster_id").join(assign, "id", "left").select("id", "cluster_id")


@of_articles("a21_apply_assignments", "SELECT id, CAST(CASE WHEN publish_date IS NULL THEN cluster_id ELSE nullif(coalesce(cluster_id, 7), -1) END AS INTEGER) AS cluster_id FROM articles")
def a21(a):
    stored = a.filter("publish_date IS NOT NULL").select("id", F.coalesce("cluster_id", F.lit(7)).alias("topic"))
    j = a.join(stored.withColumn("_set", F.lit(True)), "id", "left")
    return j.select("id", F.when(F.col("_set"), F.nullif("topic", F.lit(-1))).otherwise(F.col("cluster_id")).alias("cluster_id"))
