"""Registered queries of D4, D5, E1, E2, E19, E20, F16, F18, G5, G10, G20, G23, G26, H2, H8, I14, I15, I29 and U4 to U6."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlens.functions import sql as SQL
from litlens.functions import vectors as V
from litlens.operators import density as D
from litlens.operators import dispatch as DS
from litlens.operators import evaluate as EV
from litlens.operators import experiments as X
from litlens.operators import lexicon as L
from litlens.operators import neighbours as NN
from litlens.operators import reports as I
from litlens.operators import retrieval as R
from litlens.operators import search as G
from litlens.operators import tables as T
from litlens.operators import topics as E
from litlens.plans.base import AS_OF, ORACLES, articles, clusters, messages, of_articles, query, six, table
from litlens.plans.evaluate_queries import ANSWERS, GOLD, LAB, golden, labelled, scored_answers
from litlens.plans.report_queries import DIGEST, YEAR, digest, stored
from litlens.plans.search_queries import BM, FINAL, FUSE, KEY, LEX, ORDER, index, item_terms, merged, sql_terms, title_hits, topic_queries
from litlens.plans.vector_queries import UNIT


@of_articles("d4_embed", "SELECT id, sha256(coalesce(title, '')) AS text_hash, 'hashing' AS embedding_model, CASE WHEN trim(coalesce(title, '')) = '' THEN 0 ELSE 1 END AS length FROM articles")
def d4(a):
    """Lengths only: a blank title has a zero vector, all others length 1."""
    v = R.embed(a, "title")
    return v.select("id", "text_hash", "embedding_model", F.round(V.norm(F.col("embedding"))).cast("int").alias("length"))


@of_articles("d5_limit_scan", "SELECT id, source FROM articles ORDER BY id LIMIT 100")
def d5(a):
    return R.limit_scan(a, 100).select("id", "source")


@of_articles("e2_kmeans_topics")
def e2(a):
    return X.kmeans_topics(a, 8)


#: Outlier and merge thresholds, in the range of the given vectors' similarities.
GRID = [(0.9, 0.3), (0.2, 0.3), (0.2, 0.2), (0.25, 0.25)]
E19 = f"""{UNIT}, nr AS (SELECT u.id, c.cluster_id AS k, list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * c.c[i])) AS s FROM u CROSS JOIN c WHERE u.cluster_id = -1),
nb AS (SELECT id, k, s FROM nr QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, k) = 1),
cf AS (SELECT unnest(range({len(GRID)})) AS run, unnest([{', '.join(str(r) for r, _ in GRID)}]) AS r, unnest([{', '.join(str(m) for _, m in GRID)}]) AS m),
mv AS (SELECT run, m, u.id, u.v, CASE WHEN u.cluster_id = -1 AND nb.s >= r THEN nb.k ELSE u.cluster_id END AS k FROM cf CROSS JOIN u LEFT JOIN nb USING (id) WHERE u.cluster_id IS NOT NULL),
mx AS (SELECT run, m, k, unnest(v) AS val, unnest(range(1, len(v) + 1)) AS pos FROM mv WHERE k >= 0),
ma AS (SELECT run, m, k, list(a ORDER BY pos) AS a FROM (SELECT run, m, k, pos, avg(val) AS a FROM mx GROUP BY ALL) GROUP BY ALL),
mc AS (SELECT run, m, k, list_transform(a, lambda x: x / n) AS c FROM (SELECT *, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS n FROM ma)),
ne AS (SELECT a.run, a.k AS a, b.k AS b FROM mc a JOIN mc b ON a.run = b.run AND a.k <> b.k WHERE list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) >= a.m),
reach AS (SELECT run, k AS a, k AS b FROM mc UNION SELECT reach.run, reach.a, ne.b FROM reach JOIN ne ON ne.run = reach.run AND ne.a = reach.b),
mm AS (SELECT run, a AS k, min(b) AS topic FROM reach GROUP BY ALL),
sz AS (SELECT mv.run, topic, count(*) AS n FROM mv LEFT JOIN mm ON mm.run = mv.run AND mm.k = mv.k GROUP BY ALL)"""


@of_articles("e19_run_experiments", f"WITH RECURSIVE {E19} SELECT run, CAST(any_value(r) AS DOUBLE) AS reassign, CAST(any_value(m) AS DOUBLE) AS merge, CAST(sum(n) AS BIGINT) AS docs, count(topic) AS topics, CAST(coalesce(sum(n) FILTER (topic IS NULL), 0) AS BIGINT) AS outliers, round(coalesce(sum(n) FILTER (topic IS NULL), 0) / sum(n), 6) AS outlier_ratio, max(n) FILTER (topic IS NOT NULL) AS largest, round(max(n) FILTER (topic IS NOT NULL) / sum(n) FILTER (topic IS NOT NULL), 6) AS largest_ratio FROM sz JOIN cf USING (run) GROUP BY run")
def e19(a):
    return X.run_experiments(a.select("id", "cluster_id", "embedding"), GRID)


RUNS = "SELECT primary_category AS run, count(cluster_id) / count(*) AS coverage, count_if(cluster_id = -1) / count(*) AS outlier_ratio, CAST(NULL AS DOUBLE) AS davies_bouldin, CASE WHEN count(*) % 2 = 0 THEN 0.0 ELSE 0.25 END AS silhouette, 0.5 AS largest_ratio FROM articles GROUP BY 1"


@of_articles("e20_best_experiment", f"WITH r AS ({RUNS}) SELECT run, round(coverage, 6) AS coverage FROM r ORDER BY coverage DESC, outlier_ratio, coalesce(davies_bouldin, 'inf'), coalesce(nullif(silhouette, 0), -1) DESC, largest_ratio, run LIMIT 1")
def e20(a):
    n = F.count(F.lit(1))
    runs = a.groupBy(F.col("primary_category").alias("run")).agg((F.count("cluster_id") / n).alias("coverage"), (F.count_if(F.col("cluster_id") == -1) / n).alias("outlier_ratio"), F.lit(None).cast("double").alias("davies_bouldin"), F.when(n % 2 == 0, 0.0).otherwise(0.25).alias("silhouette"), F.lit(0.5).alias("largest_ratio"))
    return X.best_experiment(runs).select("run", F.round("coverage", 6).alias("coverage"))


CLEAN = r"trim(regexp_replace(lower(regexp_replace(replace(coalesce({}, ''), '$\pi$', ''), '[^a-zA-Z0-9\s]', '', 'g')), '\s+', ' ', 'g'))"
#: Golden rows from the toxic articles: an id; one with upper-case letters; one with more words; one with a sign inside; an unknown one.
GOLDEN = "CASE id % 5 WHEN 0 THEN 'unknown: ' || title WHEN 1 THEN translate(title, 'abet', 'ABET') WHEN 2 THEN title || ' and more' WHEN 3 THEN substr(title, 1, 9) || '!' || substr(title, 10) ELSE 'no such title at all' END"


@query("f9_match_golden", rf"""WITH gd AS (SELECT a.id AS gold_id, CASE WHEN a.id % 5 = 0 THEN a.id END AS wanted, trim({GOLDEN}) AS title FROM articles a JOIN labels l ON l.doc_id = a.id WHERE l.toxic = 1),
gx AS (SELECT *, lower(substr(title, 1, 30)) AS prefix, {CLEAN.format('title')} AS clean, list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 4) AS words FROM gd),
ax AS (SELECT id, lower(title) AS t, {CLEAN.format('title')} AS c FROM articles WHERE title IS NOT NULL),
m AS (SELECT gx.gold_id, ax.id, wanted IS NOT DISTINCT FROM ax.id AS i, lower(title) = t AND title <> '' AS e, contains(t, prefix) AND title <> '' AS p, len(words) > 0 AND len(list_filter(words, lambda w: contains(t, w))) = len(words) AS k, contains(c, clean) OR contains(clean, c) AS h FROM gx, ax),
n AS (SELECT *, row_number() OVER (PARTITION BY gold_id, k ORDER BY id) AS nth FROM m),
r AS (SELECT gold_id, min(id) FILTER (i) AS i, min(id) FILTER (e) AS e, min(id) FILTER (p AND h) AS p, min(id) FILTER (k AND h AND nth <= 5) AS k FROM n GROUP BY 1)
SELECT gold_id, coalesce(i, e, p, k) AS id, CASE WHEN i IS NOT NULL THEN 'id' WHEN e IS NOT NULL THEN 'exact' WHEN p IS NOT NULL THEN 'prefix' WHEN k IS NOT NULL THEN 'words' ELSE 'not found' END AS stage FROM r""")
def f9(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    # of the articles' texts only the titles are shuffled, once
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    titles = d.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    a = T.cut(titles.join(e.select(F.col("vec_id").alias("id")), "id", "left"))
    golden = a.join(toxic, "id").select(F.col("id").alias("gold_id"), F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).alias("article_id"), F.expr(GOLDEN).alias("title"))
    return X.match_golden(golden, a)


@query("f16_multi_run", f"WITH {LAB}, r AS (SELECT unnest(range(0, 5)) AS r), s AS (SELECT r, label = cluster_id AS ok FROM lb, r QUALIFY row_number() OVER (PARTITION BY r ORDER BY md5(r || ':' || id), id) <= 30), m AS (SELECT r, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS m FROM s GROUP BY r) SELECT round(avg(m), 6) AS direct_match_mean, round(stddev_pop(m), 6) AS direct_match_std FROM m")
def f16(spark, sf):
    return X.multi_run(labelled(spark, sf), 5, 30)


EXPECTED = f"{LAB}, ex AS (SELECT CASE WHEN lb.id % 5 = 0 THEN 'no such paper' ELSE translate(a.title, 'abet', 'ABET') END AS title, lb.label AS expected_cluster_id FROM lb JOIN articles a USING (id)), fi AS (SELECT lower(title) AS t, min(id) AS id, arg_min(coalesce(cluster_id, -9), id) AS cluster_id FROM articles GROUP BY 1)"


@query("f18_compare_expected", f"WITH {EXPECTED} SELECT count(*) AS expected, count(fi.id) AS found, count_if(coalesce(cluster_id = expected_cluster_id, FALSE)) AS correct, round(count_if(coalesce(cluster_id = expected_cluster_id, FALSE)) / count(fi.id), 6) AS accuracy FROM ex LEFT JOIN fi ON lower(ex.title) = fi.t")
def f18(spark, sf):
    a = articles(spark, sf)
    rows = labelled(spark, sf).select("id", F.col("label").alias("expected_cluster_id")).join(a.select("id", "title"), "id")
    expected = rows.select(F.when(F.col("id") % 5 == 0, "no such paper").otherwise(F.translate("title", "abet", "ABET")).alias("title"), "expected_cluster_id")
    return X.expected_counts(X.compare_expected(expected, a, clusters(spark, sf)))


@of_articles("g5_vector_search_lsh")
def g5(a):
    """Approximate: cells of an inverted file, coded residuals, the best scored anew. The query keeps the name of its first form."""
    return NN.search_index(NN.build_index(a), topic_queries(a), 25).select("query_id", "id", "score", "rank")


@of_articles("e1_density_topics")
def e1(a):
    return D.density_topics(a.select("id", "embedding"), min_topic_size=10)


G11 = ORACLES["g11_keyword_score"].rsplit(") SELECT id, ", 1)[-1].removesuffix(" AS score FROM articles")


@of_articles("g10_keyword_search", f"WITH s AS (SELECT * FROM articles WHERE title ILIKE '%the%' OR abstract_text ILIKE '%the%' ORDER BY id LIMIT 80) SELECT id, {G11} AS score FROM s ORDER BY score DESC, id LIMIT 20")
def g10(a):
    return R.keyword_search(a, ["the"], 20).select("id", F.round("score", 6).alias("score"))


WORDS = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'))"


@query("g20_rerank", f"WITH {BM}, p AS (SELECT br.query_id, br.id, br.rank, {WORDS.format('b.text')} AS q, {WORDS.format('a.title')} AS t FROM br JOIN benchmark b ON b.item_id = br.query_id JOIN articles a USING (id)), s AS (SELECT *, len(list_intersect(q, t)) / len(q) AS s FROM p) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN round(s, 9) END DESC NULLS LAST, rank) AS INTEGER) AS new_rank FROM s")
def g20(spark, sf):
    a = articles(spark, sf)
    hits = L.search(index(spark, sf), item_terms(spark, sf), 25).select("query_id", "id", "rank")
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return R.rerank(hits.join(texts, "query_id").join(a.select("id", "title"), "id"), "q", "title", 10).select("query_id", "id", "new_rank")


@query("u3_pair_scores", f"WITH {BM}, p AS (SELECT br.query_id, br.id, br.rank, {WORDS.format('b.text')} AS q, {WORDS.format('a.title')} AS t FROM br JOIN benchmark b ON b.item_id = br.query_id JOIN articles a USING (id)), s AS (SELECT *, CASE WHEN len(q) + len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))) END AS s FROM p) SELECT query_id, id, CASE WHEN rank <= 10 THEN round(s, 6) END AS pair_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN round(s, 9) END DESC NULLS LAST, rank) AS INTEGER) AS new_rank FROM s")
def u3(spark, sf):
    """The same ranking by a model in Python workers: the word sets' Jaccard similarity."""
    T.ship(spark)
    hits = L.search(index(spark, sf), item_terms(spark, sf), 25).select("query_id", "id", "rank")
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    pairs = hits.join(texts, "query_id").join(articles(spark, sf).select("id", "title"), "id")
    return R.rerank(pairs, "q", "title", 10, R.model_scorer(R.WordSets)).select("query_id", "id", F.round("pair_score", 6).alias("pair_score"), "new_rank")


#: Queries of seven kinds from the benchmark items: newest first of a source; three named ids; vectors of a source; terms with
#: categories and citations; hybrid from a date on; hybrid without filters, of which some have no terms; BM25 without terms.
KIND = "item_id % 7"
ASKED_SQL = f"""qs AS (SELECT item_id AS query_id, {KIND} AS kind, CASE WHEN {KIND} = 6 OR item_id % 14 = 5 THEN CAST([] AS VARCHAR[]) ELSE {sql_terms('text')} END AS terms, [item_id, item_id + 1, item_id + 19] AS ids FROM benchmark),
am AS (SELECT *, {KEY} AS key, {FINAL.removeprefix('0.5 + ')} AS fs FROM articles)"""
EARLY = "(kind <> 1 OR list_contains(ids, a.id)) AND (kind <> 0 OR a.source = 'arxiv') AND (kind <> 2 OR a.source = 'openalex') AND (kind <> 3 OR a.categories ILIKE '%cs.AI%' OR a.categories ILIKE '%stat.ML%') AND (kind <> 4 OR a.publish_date >= timestamp '2018-01-01 00:00:00')"
LATE = f"{EARLY} AND (kind <> 3 OR a.citation_count >= 10)"
DISPATCH = f"""{UNIT}, {LEX}, {ASKED_SQL},
lt AS (SELECT query_id, a.id, key, row_number() OVER (PARTITION BY query_id ORDER BY publish_date DESC, a.id DESC) AS n FROM qs JOIN am a ON {LATE} WHERE kind = 0 AND publish_date IS NOT NULL QUALIFY n <= 25),
lk AS (SELECT query_id, id, n FROM lt QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY n) = 1),
lo AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank, 'latest' AS retrieval_source FROM lk QUALIFY rank <= 5),
di AS (SELECT query_id, a.id, fs FROM qs JOIN am a ON {LATE} WHERE kind = 1 QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY round(fs, 9) DESC, a.id) = 1),
dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 9) DESC, id) AS rank, 'lookup' AS retrieval_source FROM di QUALIFY rank <= 5),
qv AS (SELECT query_id, kind, ids, v FROM qs JOIN u ON u.id = query_id WHERE kind IN (2, 4, 5)),
vq AS (SELECT q.query_id, a.id, greatest(0, list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * q.v[i]))) AS score FROM qv q JOIN am a ON {LATE} JOIN u ON u.id = a.id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM vq QUALIFY rank <= 25),
qt AS (SELECT query_id, unnest(terms) AS term FROM qs WHERE kind IN (3, 4, 5, 6)),
bs AS (SELECT query_id, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (3.0 * tf_title + tf_abstract) * 2.2 / ((3.0 * tf_title + tf_abstract) + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM qt JOIN po USING (term) JOIN te USING (term) JOIN ln_ USING (id), tt GROUP BY 1, 2),
be AS (SELECT query_id, a.id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, a.id) AS r FROM bs JOIN qs USING (query_id) JOIN am a ON a.id = bs.id WHERE {EARLY} QUALIFY r <= 100),
br AS (SELECT query_id, a.id, score, r AS rank FROM be JOIN qs USING (query_id) JOIN am a ON a.id = be.id WHERE {LATE} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 25),
ky AS (SELECT id, key FROM am),
v1 AS (SELECT query_id, key, arg_min(id, rank) AS vid, max(rank) AS vector_rank, arg_max(score, rank) AS vector_score FROM vr JOIN ky USING (id) GROUP BY 1, 2),
b1 AS (SELECT query_id, key, arg_min(id, rank) AS bid, max(rank) AS bm25_rank, arg_max(score, rank) AS bm25_score FROM br JOIN ky USING (id) GROUP BY 1, 2),
mg AS (SELECT query_id, coalesce(vid, bid) AS id, vector_rank, vector_score, bm25_rank, bm25_score, CASE WHEN vid IS NOT NULL AND bid IS NOT NULL THEN 'both' WHEN vid IS NOT NULL THEN 'vector' ELSE 'bm25' END AS retrieval_source, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS fusion_score FROM v1 FULL JOIN b1 USING (query_id, key)),
fr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank, retrieval_source FROM mg QUALIFY rank <= 5),
an AS (SELECT * FROM lo UNION ALL SELECT * FROM dr UNION ALL SELECT * FROM fr)"""


def asked(spark, sf):
    """The queries as rows, with filters of their own."""
    kind, item = F.col("item_id") % 7, F.col("item_id")
    of = lambda k, value: F.when(kind == k, value)
    none = F.expr("cast(array() as array<string>)")
    rows = table(spark, sf, "benchmark").join(articles(spark, sf).select(F.col("id").alias("item_id"), "embedding"), "item_id", "left")
    return rows.select(
        item.alias("query_id"), "text", F.when(kind.isin(2, 4, 5), F.col("embedding")).alias("vector"), F.when((kind == 6) | (item % 14 == 5), none).otherwise(G.query_terms(F.col("text"))).alias("terms"),
        F.when(kind == 2, "vector").when(kind.isin(3, 6), "bm25").otherwise("hybrid").alias("mode"), of(0, F.lit("publish_date_desc")).alias("sort_by"), of(1, F.array(item, item + 1, item + 19)).alias("article_ids"),
        F.when(kind == 0, "arxiv").when(kind == 2, "openalex").alias("source"), of(3, F.array(F.lit("cs.AI"), F.lit("stat.ML"))).alias("categories_any"), of(3, F.lit(10)).alias("min_citation_count"), of(4, F.lit("2018-01-01").cast("timestamp")).alias("publish_date_from"),
    )


@query("g23_search", f"WITH {DISPATCH} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, retrieval_source FROM an")
def g23(spark, sf):
    return DS.dispatch(articles(spark, sf), index(spark, sf), asked(spark, sf), AS_OF).select("query_id", "id", "rank", "retrieval_source")


ASKED = ("what says s 2 on it", "S9 please", "ilk makale nedir", "ikinci kaynak", "bunlar neler", "bu makale ne diyor", "something else")


@query("g26_resolve_followups", "WITH m AS (SELECT id, [{}][id % 7 + 1] AS t, CASE WHEN chat_id % 3 = 0 THEN CAST([] AS BIGINT[]) ELSE [chat_id, chat_id + 1, chat_id + 2] END AS s FROM messages WHERE role = 'user') SELECT id, array_to_string(CASE WHEN len(s) = 0 THEN [] WHEN id % 7 = 0 THEN [s[2]] WHEN id % 7 = 2 THEN [s[1]] WHEN id % 7 = 3 THEN [s[2]] WHEN id % 7 = 4 THEN s WHEN id % 7 = 5 THEN [s[3]] ELSE [] END, ',') AS ids FROM m".format(", ".join(f"'{t}'" for t in ASKED)))
def g26(spark, sf):
    m = messages(spark, sf).filter("role = 'user'")
    text = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("id") % 7 + 1).cast("int"))
    chat = F.col("chat_id").cast("long")
    m = m.select("id", text.alias("t"), F.when(chat % 3 == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(chat, chat + 1, chat + 2)).alias("sources"))
    return R.resolve_followups(m, "t").select("id", F.array_join("article_ids", ",").alias("ids"))


#: The benchmark items as questions: routed, with the filters of their kind over those of their text, answered and scored.
EVALUATED = f"""{DISPATCH.replace("'latest' AS retrieval_source", "'vector' AS retrieval_source").replace("'lookup' AS retrieval_source", "'vector' AS retrieval_source")}, {GOLD.split(", rk AS")[0]},
ro AS (SELECT item_id AS query_id, {KIND} AS kind FROM benchmark),
rl AS (SELECT go.question_id, len(expected) AS m, x.id, an.rank AS pos FROM go, unnest(expected) AS x(id) LEFT JOIN an ON an.query_id = go.question_id AND an.id = x.id),
sc AS (SELECT question_id, count(pos) > 0 AS hit_at_k, round(count(pos) / max(m), 6) AS recall_at_k, round(count(pos) / 5, 6) AS precision_at_k, round(coalesce(1 / min(pos), 0), 6) AS mrr, round(coalesce(sum(1 / log2(pos + 1)), 0) / list_sum(list_transform(range(1, least(max(m), 5) + 1), lambda p: 1 / log2(p + 1))), 6) AS ndcg_at_k FROM rl GROUP BY question_id),
si AS (SELECT query_id, round(1 - count(DISTINCT id) / count(*), 6) AS duplicate_rate, count_if(retrieval_source = 'vector') AS n_vector, count_if(retrieval_source = 'bm25') AS n_bm25, count_if(retrieval_source = 'both') AS n_both, count(*) AS source_count FROM an GROUP BY 1)"""


@query("h2_evaluate_retrieval", f"WITH {EVALUATED} SELECT ro.query_id AS question_id, TRUE AS uses_rag, CASE WHEN kind = 0 THEN 'publish_date_desc' ELSE 'relevance' END AS sort_by, 5 AS top_k, hit_at_k, recall_at_k, precision_at_k, mrr, ndcg_at_k, coalesce(duplicate_rate, 0) AS duplicate_rate, coalesce(n_vector, 0) AS n_vector, coalesce(n_bm25, 0) AS n_bm25, coalesce(n_both, 0) AS n_both, coalesce(source_count, 0) AS source_count, source_count IS NULL AS retrieved_context_empty FROM ro LEFT JOIN sc ON sc.question_id = ro.query_id LEFT JOIN si ON si.query_id = ro.query_id")
def h2(spark, sf):
    """The items' texts name no facet, so every filter is the question's own; all are forced to search, as in the reference runs
    of a golden set. A question of kind 0 asks for the newest in its text."""
    q = asked(spark, sf)
    item = F.col("query_id")
    text = F.when(item % 7 == 0, "latest papers").when(F.size("terms") == 0, "").otherwise(F.col("text"))
    expected = golden(spark, sf).withColumnRenamed("question_id", "query_id")
    over = F.struct("article_ids", "source", "categories_any", "min_citation_count", "publish_date_from")
    questions = q.join(expected, "query_id", "left").select(item.alias("question_id"), text.alias("question"), "expected", "vector", "mode", over.alias("overrides"), F.lit(None).cast("int").alias("own_top_k"))
    return six(DS.evaluate_retrieval(questions, articles(spark, sf), index(spark, sf), AS_OF, forced=True))


@of_articles("h8_summarize_answers", f"WITH {ANSWERS} SELECT count(*) AS question_count, round(avg(CASE WHEN doi IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS retrieval_hit_rate, round(avg(CAST(title_mentioned AS INT)), 6) AS expected_title_mention_rate, round(avg(term_recall), 6) AS mean_key_term_coverage, round(avg(citation_marker_count), 6) AS mean_citation_marker_count, round(avg(CAST(has_sources_section AS INT)), 6) AS sources_section_rate FROM sa JOIN articles USING (id)")
def h8(a):
    """Rates over the scored answers of h6; an article with a DOI counts as found."""
    return X.summarize_answers(scored_answers(a).join(a.select("id", F.col("doi").isNotNull().alias("retrieval_hit")), "id"))


@query("h9_compare_systems", f"""WITH {FUSE}, f AS (SELECT *, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS fusion_score FROM mg), fr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM f),
ex AS (SELECT cluster_id AS question_id, id FROM articles WHERE cluster_id >= 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY citation_count DESC NULLS LAST, id) <= 20),
rk AS (SELECT 'vector' AS system, query_id, id, rank FROM vr UNION ALL SELECT 'bm25', query_id, id, rank FROM br UNION ALL SELECT 'fused', query_id, id, rank FROM fr),
rl AS (SELECT s.system, ex.question_id, rk.rank AS pos FROM ex CROSS JOIN (SELECT unnest(['vector', 'bm25', 'fused']) AS system) s LEFT JOIN rk ON rk.system = s.system AND rk.query_id = ex.question_id AND rk.id = ex.id AND rk.rank <= 25),
sc AS (SELECT system, question_id, coalesce(1 / min(pos), 0) AS mrr, count(pos) / count(*) AS recall FROM rl GROUP BY 1, 2) SELECT system, round(avg(mrr), 6) AS mean_mrr, round(avg(recall), 6) AS mean_recall, count(*) AS questions FROM sc GROUP BY 1""")
def h9(spark, sf):
    """Vector, BM25 and fused ranks of the topics' queries; each topic's twenty most cited articles are the expected ones."""
    a = articles(spark, sf)
    cited = a.filter("cluster_id >= 0").select(F.col("cluster_id").alias("query_id"), "id", "citation_count")
    golden = G.top(cited, [F.desc_nulls_last("citation_count"), F.col("id")], 20).groupBy(F.col("query_id").alias("question_id")).agg(F.sort_array(F.collect_list("id")).alias("expected"))
    runs = {"vector": G.vector_search(a, topic_queries(a), 25), "bm25": title_hits(spark, sf), "fused": G.fuse_rrf(merged(spark, sf)).withColumn("rank", F.col("fusion_rank"))}
    return six(X.compare_systems(golden, {k: df.select(F.col("query_id").alias("question_id"), "id", "rank") for k, df in runs.items()}, 25))


@of_articles("i14_report_key", "SELECT DISTINCT source, primary_category, 'v1:' || substr(sha256('{\"category\": \"' || primary_category || '\", \"period\": \"12m\", \"source\": \"' || source || '\"}'), 1, 24) AS key FROM articles")
def i14(a):
    """Keys of all reports by source and category."""
    return a.select("source", "primary_category").distinct().withColumn("key", I.report_keys("v1", category=F.col("primary_category"), period=F.lit("12m"), source=F.col("source")))


IN_CV = "(primary_category = 'cs.CV' OR coalesce(categories ILIKE '%cs.CV%', FALSE))"


@query("i15_dashboard", f"""WITH st AS (SELECT * EXCLUDE (cluster_id), nullif(cluster_id, -1) AS cluster_id FROM articles WHERE {YEAR}), sh AS (SELECT * FROM st WHERE source = 'arxiv' AND {IN_CV}),
kp AS (SELECT count(*) AS total_papers, count(DISTINCT cluster_id) AS active_clusters, coalesce(count(cluster_id) / nullif(count(DISTINCT cluster_id), 0), 0) AS avg_papers_per_cluster, count_if(publish_date >= timestamp '{AS_OF}' - INTERVAL 7 DAY) AS weekly_picks, count(cluster_id) AS clustered_papers, count(pdf_url) AS pdf_available FROM sh),
un AS (SELECT 'kpis' AS part, name AS key, CAST(v AS DOUBLE) AS value FROM (SELECT unnest(['total_papers', 'active_clusters', 'avg_papers_per_cluster', 'weekly_picks', 'clustered_papers', 'pdf_available']) AS name, unnest([total_papers, active_clusters, avg_papers_per_cluster, weekly_picks, clustered_papers, pdf_available]) AS v FROM kp)
UNION ALL SELECT 'cluster_counts', CAST(cluster_id AS VARCHAR), count(*) FROM sh JOIN clusters USING (cluster_id) GROUP BY cluster_id
UNION ALL SELECT * FROM (SELECT 'monthly_counts', strftime(publish_date, '%Y-%m') AS m, count(*) FROM sh GROUP BY 2 ORDER BY 2 DESC LIMIT 12)
UNION ALL SELECT 'sources', coalesce(source, 'unknown'), count(*) FROM st WHERE {IN_CV} GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'categories', coalesce(primary_category, 'unknown') AS c, count(*) FROM st WHERE source = 'arxiv' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'pie', CAST(cluster_id AS VARCHAR), article_count FROM clusters ORDER BY article_count DESC, cluster_id LIMIT 8))
SELECT part, key, round(value, 6) AS value FROM un""")
def i15(spark, sf):
    """Every table of the bundle, under a filter on source and category."""
    parts = I.dashboard(stored(articles(spark, sf)), clusters(spark, sf), AS_OF, "arxiv", "cs.CV")
    parts["kpis"] = parts["kpis"].select(*[F.col(c).cast("double").alias(c) for c in parts["kpis"].columns])
    parts["kpis"] = parts["kpis"].unpivot([], parts["kpis"].columns, "key", "value")
    two = {"cluster_counts": ("cluster_id", "paper_count"), "monthly_counts": ("month_key", "count"), "sources": ("source", "count"), "categories": ("category", "count"), "pie": ("cluster_id", "article_count"), "kpis": ("key", "value")}
    rows = [df.select(F.lit(k).alias("part"), F.col(two[k][0]).cast("string").alias("key"), F.round(F.col(two[k][1]).cast("double"), 6).alias("value")) for k, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@of_articles("i29_digest_sources", f"{DIGEST} SELECT dg.cluster_id, 'S' || CAST(dg.position AS VARCHAR) AS source_id, dg.id AS article_id, round(coalesce(rp.score, 1.0 / rp.rank, 0), 6) AS centrality_score FROM dg LEFT JOIN rp ON rp.id = dg.id AND rp.cluster_id = dg.cluster_id")
def i29(a):
    return I.digest_sources(digest(a), I.centrality(E.representatives(a))).select("cluster_id", "source_id", "article_id", F.round("centrality_score", 6).alias("centrality_score"))


@of_articles("u4_vector_mean", "WITH e AS (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM articles WHERE cluster_id >= 0 AND embedding IS NOT NULL) SELECT cluster_id, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e WHERE i <= 4 GROUP BY 1, 2")
def u4(a):
    m = V.centroids(a.filter("cluster_id >= 0"), "cluster_id", "embedding", normalized=False)
    return m.select("cluster_id", F.posexplode(F.slice("centroid", 1, 4)).alias("p", "m")).select("cluster_id", (F.col("p") + 1).alias("i"), F.round("m", 6).alias("mean"))


@query("u5_text_terms", r"SELECT item_id, term, CAST(position AS INTEGER) AS position FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS position FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark))")
def u5(spark, sf):
    SQL.register(spark)
    return spark.sql("SELECT item_id, term, position FROM {b} b, LATERAL text_terms(b.text)", b=table(spark, sf, "benchmark"))


@query("u6_sql_functions", r"""SELECT item_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS INTEGER) AS n, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, CAST(len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> '')) AS INTEGER) AS words, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> ''), 1, 7), ' ') AS first,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' $$x$$ \alpha {b}', '[$]+', ' ', 'g'), '\\[a-zA-Z]+', ' ', 'g'), '[{}]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS light, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'), '[^\p{L}\p{N}_ ]', '', 'g'), ' +', ' ', 'g')) AS key, '10.1/' || CAST(item_id AS VARCHAR) AS doi, round(least(0.65, ln(1 + length(text)) / 5), 6) AS component, CASE WHEN item_id = 0 THEN 0 ELSE round(CAST(item_id AS DOUBLE) / (sqrt(2) * item_id), 6) END AS cosine FROM benchmark""")
def u6(spark, sf):
    SQL.register(spark)
    b = table(spark, sf, "benchmark")
    return spark.sql(r"""SELECT item_id, litlens_count_terms(text) AS n, litlens_clean_ws(text) AS clean, litlens_count_words(text) AS words, litlens_truncate_words(text, 7) AS first, litlens_light_clean(text || ' $$x$$ \\alpha {{b}}') AS light, litlens_title_key(text) AS key,
litlens_normalize_doi('https://doi.org/10.1/' || item_id) AS doi, round(litlens_keyword_component(length(text)), 6) AS component, round(litlens_cosine(array(double(item_id), 0D), array(1D, 1D)), 6) AS cosine FROM {b}""", b=b)
