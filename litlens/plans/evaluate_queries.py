"""Registered queries of groups F and H."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlens.operators import evaluate as V
from litlens.operators import lexicon as L
from litlens.operators import matching as MA
from litlens.plans.base import articles, of_articles, query, six, table
from litlens.plans.search_queries import BM, index, item_terms
from litlens.plans.vector_queries import UNIT


DIM = """
vs AS (SELECT cluster_id, pos, sum(val) AS x, count(*) AS n, sum(val * val) AS q FROM ux GROUP BY ALL),
cs AS (SELECT cluster_id, list(x ORDER BY pos) AS s, max(n) AS n, sum(q) AS q FROM vs GROUP BY cluster_id),
dot AS (SELECT u.id, u.cluster_id, cs.cluster_id AS k, cs.n, list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * cs.s[i])) AS d FROM u CROSS JOIN cs WHERE u.cluster_id >= 0)"""


@of_articles("f1_cluster_coverage", "SELECT count(*) AS articles, count(embedding) AS embedded, count_if(cluster_id >= 0) AS clustered, count_if(cluster_id = -1) AS outliers, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS clusters, round(count_if(cluster_id >= 0) / count(embedding), 6) AS coverage, round(count_if(cluster_id = -1) / count(cluster_id), 6) AS outlier_ratio FROM articles")
def f1(a):
    return six(V.cluster_coverage(a))


@of_articles("f2_silhouette", f"WITH {UNIT}, {DIM}, ab AS (SELECT id, max(CASE WHEN k = cluster_id THEN CASE WHEN n > 1 THEN (n - d) / (n - 1) END END) AS a, min(CASE WHEN k <> cluster_id THEN 1 - d / n END) AS b FROM dot GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab")
def f2(a):
    return six(V.silhouette(a))


@of_articles("f3_davies_bouldin", f"WITH {UNIT}, {DIM}, cc AS (SELECT cluster_id, list_transform(s, lambda x: x / n) AS c FROM cs), dd AS (SELECT cluster_id, avg(list_distance(u.v, cc.c)) AS d FROM u JOIN cc USING (cluster_id) GROUP BY 1), k AS (SELECT * FROM cc JOIN dd USING (cluster_id)), r AS (SELECT a.cluster_id, max((a.d + b.d) / list_distance(a.c, b.c)) AS r FROM k a JOIN k b ON a.cluster_id <> b.cluster_id GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def f3(a):
    return six(V.davies_bouldin(a))


@of_articles("f4_calinski_harabasz", f"WITH {UNIT}, {DIM}, g AS (SELECT pos, avg(val) AS m FROM ux GROUP BY pos), cc AS (SELECT cluster_id, pos, avg(val) AS m, count(*) AS n FROM ux GROUP BY 1, 2), b AS (SELECT sum(n * (cc.m - g.m) * (cc.m - g.m)) AS b FROM cc JOIN g USING (pos)), w AS (SELECT sum((val - m) * (val - m)) AS w FROM ux JOIN cc USING (cluster_id, pos)), t AS (SELECT sum(n) AS n, count(*) AS k FROM cs) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w, t")
def f4(a):
    return six(V.calinski_harabasz(a))


@of_articles("f5_intra_cosine", f"WITH {UNIT}, {DIM} SELECT round(sum((list_sum(list_transform(s, lambda x: x * x)) - q) / 2) / sum(n * (n - 1) / 2), 6) AS intra_cosine FROM cs")
def f5(a):
    return six(V.intra_cosine(a, 500))


@of_articles("f6_centroid_similarity", f"WITH {UNIT} SELECT round(avg(list_cosine_similarity(u.v, c.c)), 6) AS centroid_similarity FROM u JOIN c USING (cluster_id)")
def f6(a):
    return six(V.centroid_similarity(a))


@of_articles("f7_size_stats", "SELECT median(n) AS median_size, round(max(n) / sum(n), 6) AS largest_ratio FROM (SELECT count(*) AS n FROM articles WHERE cluster_id >= 0 GROUP BY cluster_id)")
def f7(a):
    return six(V.size_stats(a))


@of_articles("f8_evaluation_status", "SELECT 'ok' AS status, count_if(cluster_id >= 0) > count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS scorable FROM articles")
def f8(a):
    return V.evaluation_status(a)


LAB = "lb AS (SELECT a.id, l.quality * 2 + l.toxic AS label, a.cluster_id FROM articles a JOIN labels l ON l.doc_id = a.id WHERE a.cluster_id >= 0), ct AS (SELECT label, cluster_id, count(*) AS n FROM lb GROUP BY 1, 2)"


def labelled(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return articles(spark, sf).filter("cluster_id >= 0").select("id", "cluster_id").join(lab, "id")


@query("f10_direct_match", f"WITH {LAB} SELECT round(avg(CASE WHEN label = cluster_id THEN 1.0 ELSE 0.0 END), 6) AS direct_match FROM lb")
def f10(spark, sf):
    return six(labelled(spark, sf).agg(F.avg(F.when(F.col("label") == F.col("cluster_id"), 1.0).otherwise(0.0)).alias("direct_match")))


@query("f11_contingency", f"WITH {LAB} SELECT label, cluster_id, n FROM ct")
def f11(spark, sf):
    return V.contingency(labelled(spark, sf))


#: All assignments of the four labels to clusters, the best first; of equal ones that with the smaller clusters. ka: none.
OPTIMAL = f"""{LAB}, ka AS (SELECT DISTINCT cluster_id AS k FROM ct UNION ALL SELECT NULL), kn AS (SELECT l, k, CASE WHEN k IS NULL THEN 0 ELSE coalesce(n, 0) END AS n FROM (SELECT unnest([0, 1, 2, 3]) AS l) CROSS JOIN ka LEFT JOIN ct ON ct.label = l AND ct.cluster_id = k WHERE k IS NULL OR l IN (SELECT label FROM ct)),
om AS (SELECT a.k AS k0, b.k AS k1, c.k AS k2, d.k AS k3 FROM kn a, kn b, kn c, kn d WHERE a.l = 0 AND b.l = 1 AND c.l = 2 AND d.l = 3 AND (a.k <> b.k OR a.k IS NULL OR b.k IS NULL) AND (a.k <> c.k OR a.k IS NULL OR c.k IS NULL) AND (a.k <> d.k OR a.k IS NULL OR d.k IS NULL) AND (b.k <> c.k OR b.k IS NULL OR c.k IS NULL) AND (b.k <> d.k OR b.k IS NULL OR d.k IS NULL) AND (c.k <> d.k OR c.k IS NULL OR d.k IS NULL)
ORDER BY a.n + b.n + c.n + d.n DESC, a.k NULLS LAST, b.k NULLS LAST, c.k NULLS LAST, d.k NULLS LAST LIMIT 1),
op AS (SELECT label, cluster_id, n FROM (SELECT unnest([0, 1, 2, 3]) AS label, unnest([k0, k1, k2, k3]) AS cluster_id FROM om) JOIN ct USING (label, cluster_id))"""


@query("f12_optimal_mapping", f"WITH {OPTIMAL} SELECT label, cluster_id, n FROM op")
def f12(spark, sf):
    return MA.optimal_mapping(V.contingency(labelled(spark, sf)))


@query("f13_purity", f"WITH {LAB} SELECT round(sum(m) / sum(t), 6) AS purity FROM (SELECT cluster_id, max(n) AS m, sum(n) AS t FROM ct GROUP BY 1)")
def f13(spark, sf):
    return six(V.purity(V.contingency(labelled(spark, sf))))


@query("f14_adjusted_rand", f"WITH {LAB}, x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM ct GROUP BY label)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM ct GROUP BY cluster_id)), b AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) * (sum(n) - 1) / 2 AS al FROM ct) SELECT round((ij - x * y / al) / ((x + y) / 2 - x * y / al), 6) AS adjusted_rand FROM x, y, b")
def f14(spark, sf):
    return six(V.adjusted_rand(V.contingency(labelled(spark, sf))))


@query("f15_nmi", f"WITH {LAB}, t AS (SELECT sum(n) AS t FROM ct), x AS (SELECT label, sum(n) AS x FROM ct GROUP BY 1), y AS (SELECT cluster_id, sum(n) AS y FROM ct GROUP BY 1), m AS (SELECT sum(n / t * ln(n * t / (x * y))) AS mi FROM ct JOIN x USING (label) JOIN y USING (cluster_id), t) SELECT round(2 * mi / ((SELECT sum(-x / t * ln(x / t)) FROM x, t) + (SELECT sum(-y / t * ln(y / t)) FROM y, t)), 6) AS nmi FROM m")
def f15(spark, sf):
    return six(V.nmi(V.contingency(labelled(spark, sf))))


@query("f17_match_status", f"WITH {OPTIMAL}, pm AS (SELECT cluster_id, label AS pl FROM ct QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) = 1), al AS (SELECT a.id, l.quality * 2 + l.toxic AS label, nullif(a.cluster_id, -1) AS cluster_id FROM articles a JOIN labels l ON l.doc_id = a.id) SELECT id, CASE WHEN al.cluster_id IS NULL THEN 'not found' WHEN al.label = al.cluster_id THEN 'direct' WHEN al.label = op.label THEN 'optimal' WHEN al.label = pl THEN 'purity' ELSE 'mismatch' END AS status FROM al LEFT JOIN pm USING (cluster_id) LEFT JOIN op USING (cluster_id)")
def f17(spark, sf):
    """Every labelled article; those without a cluster, or outside all, are not found."""
    ct = V.contingency(labelled(spark, sf))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    rows = articles(spark, sf).select("id", F.nullif("cluster_id", F.lit(-1)).alias("cluster_id")).join(lab, "id")
    return MA.match_status(rows, MA.optimal_mapping(ct), V.purity_mapping(ct))


#: The documents that hold each benchmark item, and the item's hits by BM25.
GOLD = "go AS (SELECT b.item_id AS question_id, list(d.doc_id ORDER BY d.doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1), rk AS (SELECT query_id AS question_id, id, rank FROM br)"


#: Up to so many different first words of benchmark items are written into the expression that looks for them.
MOST_STARTS = 4096


def golden(spark, sf):
    """Benchmark items and the documents that hold them. The first and the last word of an item may be parts of longer ones; the
    words between them are whole, so four of those are the key of an equi join before the whole text is looked for. Items with
    fewer words meet all documents, as a broadcast table if they are few."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item")).filter("item IS NOT NULL")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    split = lambda c: F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " ")
    inner = items.withColumn("w", F.slice(split("item"), F.lit(2), F.greatest(F.size(split("item")) - 2, F.lit(0))))
    keyed = inner.filter("size(w) >= 4").select("item_id", "item", F.xxhash64(*[F.col("w")[i] for i in range(4)]).alias("k"))
    # runs that begin like an item's are hashed; with too many different beginnings all are
    starts = [r[0] for r in inner.filter("size(w) >= 4").select(F.col("w")[0]).distinct().limit(MOST_STARTS + 1).collect()]
    begins = lambda x: x.isin(*starts) if 0 < len(starts) <= MOST_STARTS else F.lit(bool(starts))
    grams = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 3, F.lit(0))), lambda x, i: F.when(begins(x), F.xxhash64(x, *[F.get("w", i + j) for j in (1, 2, 3)])))
    hashed = docs.withColumn("w", split("text")).select("doc_id", F.explode(F.array_distinct(F.array_compact(grams))).alias("k"))
    cand = hashed.join(keyed, "k").select("doc_id", "item_id", "item").distinct()
    hits = cand.join(docs, "doc_id").filter(F.col("text").contains(F.col("item"))).select("item_id", "doc_id")
    short = inner.filter("size(w) < 4").select("item_id", "item")
    if 0 < (n := short.limit(1001).count()):
        hits = hits.unionByName(docs.join(F.broadcast(short) if n <= 1000 else short, F.col("text").contains(F.col("item"))).select("item_id", "doc_id"))
    return hits.groupBy(F.col("item_id").alias("question_id")).agg(F.sort_array(F.collect_list("doc_id")).alias("expected"))


def ranked(spark, sf):
    """The items' hits by BM25."""
    return L.search(index(spark, sf), item_terms(spark, sf), 25).select(F.col("query_id").alias("question_id"), "id", "rank")


SCORED = f"""{BM}, {GOLD}, rl AS (SELECT question_id, m, rk.rank AS pos FROM (SELECT question_id, len(expected) AS m, unnest(expected) AS id FROM go) e LEFT JOIN rk ON rk.question_id = e.question_id AND rk.id = e.id AND rk.rank <= 5),
sc AS (SELECT question_id, count(pos) > 0 AS hit_at_k, count(pos) / max(m) AS recall_at_k, count(pos) / 5 AS precision_at_k, coalesce(1 / min(pos), 0) AS mrr, coalesce(sum(1 / log2(pos + 1)), 0) / list_sum(list_transform(range(1, least(max(m), 5) + 1), lambda p: 1 / log2(p + 1))) AS ndcg_at_k FROM rl GROUP BY question_id)"""
SCORED = SCORED.replace("SELECT question_id, m, rk.rank", "SELECT e.question_id, m, rk.rank")


@query("h1_score_retrieval", f"WITH {SCORED} SELECT question_id, hit_at_k, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(mrr, 6) AS mrr, round(ndcg_at_k, 6) AS ndcg_at_k FROM sc")
def h1(spark, sf):
    g = golden(spark, sf)
    return six(V.score_retrieval(g, ranked(spark, sf), 5))


@query("h3_summarize", f"WITH {SCORED} SELECT count(*) AS question_count, round(avg(CAST(hit_at_k AS INT)), 6) AS hit_rate_at_k, round(avg(recall_at_k), 6) AS mean_recall_at_k, round(avg(precision_at_k), 6) AS mean_precision_at_k, round(avg(mrr), 6) AS mean_mrr, round(avg(ndcg_at_k), 6) AS mean_ndcg_at_k FROM sc")
def h3(spark, sf):
    g = golden(spark, sf)
    return six(V.summarize_retrieval(V.score_retrieval(g, ranked(spark, sf), 5).withColumn("hit_at_k", F.col("hit_at_k").cast("int"))))


@of_articles("h4_signals", "SELECT cluster_id AS question_id, round(1 - count(DISTINCT doi) / count(*), 6) AS duplicate_rate, count_if(source = 'arxiv') AS n_vector, count_if(source = 'openalex') AS n_bm25, count_if(source = 'semanticscholar') AS n_both FROM articles WHERE cluster_id >= 0 GROUP BY 1")
def h4(a):
    src = F.when(F.col("source") == "arxiv", "vector").when(F.col("source") == "openalex", "bm25").otherwise("both")
    return six(V.retrieval_signals(a.filter("cluster_id >= 0").select(F.col("cluster_id").alias("question_id"), F.col("doi").alias("id"), src.alias("retrieval_source"))))


@query("h5_answer_signals", r"SELECT chat_id, id, CAST(len(regexp_extract_all(content, '\[S\d+\]')) AS INTEGER) AS citation_marker_count, regexp_matches(content, '(?i)(^|\n)\s*(?:#+\s*)?(?:Sources|Kaynaklar)\b\s*:?') AS has_sources_section FROM messages")
def h5(spark, sf):
    from litlens.plans.base import messages

    return messages(spark, sf).select("chat_id", "id", *[c.alias(k) for k, c in V.answer_signals(F.col("content")).items()])


TERMS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-zA-Z][a-zA-Z0-9-]{{4,}}'), lambda w: w NOT IN ('the', 'and', 'with', 'that', 'this', 'from', 'into', 'uses', 'use', 'for', 'through', 'both', 'real'))"


@of_articles("h7_important_terms", f"SELECT id, coalesce(array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 20), '|'), '') AS terms FROM (SELECT id, {TERMS.format('title')} AS w FROM articles)")
def h7(a):
    return a.select("id", F.array_join(V.important_terms(F.col("title")), "|").alias("terms"))


#: Answers: the abstracts, with marks, a sources section or a phrase of missing evidence in some; evidence: the article before.
ANSWERS = f"""an AS (SELECT a.id, a.title, CASE a.id % 4 WHEN 0 THEN a.title || ' [S1] and [S2]' || chr(10) || coalesce(a.abstract_text, '') || chr(10) || '## Sources:' || chr(10) || '[S1]' WHEN 1 THEN 'The database does not contain enough evidence.' ELSE a.abstract_text END AS answer,
list_slice(list_filter(regexp_extract_all(lower(coalesce(a.title, '')), '[a-z]+'), lambda w: length(w) > 3), 1, 4) AS keys, b.abstract_text AS evidence FROM articles a LEFT JOIN articles b ON b.id = a.id - 1),
ap AS (SELECT *, trim(regexp_replace(lower(coalesce(answer, '')), '[\\s\\p{{Z}}]+', ' ', 'g')) AS plain, trim(regexp_replace(lower(coalesce(title, '')), '[\\s\\p{{Z}}]+', ' ', 'g')) AS wanted, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 20) AS ev FROM (SELECT *, {TERMS.format('evidence')} AS w FROM an)),
sa AS (SELECT id, contains(plain, wanted) AS title_mentioned, CASE WHEN len(keys) > 0 THEN len(list_filter(keys, lambda x: contains(plain, x))) / len(keys) ELSE 0 END AS term_recall, CASE WHEN len(ev) > 0 THEN len(list_filter(ev, lambda x: contains(plain, x))) / len(ev) ELSE 0 END AS evidence_recall,
CAST(len(regexp_extract_all(coalesce(answer, ''), '\\[S\\d+\\]')) AS INTEGER) AS citation_marker_count, regexp_matches(coalesce(answer, ''), '(?i)(^|\\n)\\s*(?:#+\\s*)?(?:Sources|Kaynaklar)\\b\\s*:?') AS has_sources_section, regexp_matches(coalesce(answer, ''), '(?i){V.INSUFFICIENT}') AS insufficient_evidence, CAST(length(coalesce(answer, '')) AS INTEGER) AS answer_chars FROM ap)"""


def scored_answers(a):
    before = a.select((F.col("id") + 1).alias("id"), F.col("abstract_text").alias("evidence"))
    text = F.concat(F.col("title"), F.lit(" [S1] and [S2]\n"), F.coalesce("abstract_text", F.lit("")), F.lit("\n## Sources:\n[S1]"))
    answer = F.when(F.col("id") % 4 == 0, text).when(F.col("id") % 4 == 1, "The database does not contain enough evidence.").otherwise(F.col("abstract_text"))
    keys = F.slice(F.filter(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3), 1, 4)
    rows = a.join(before, "id", "left").select("id", "title", answer.alias("answer"), keys.alias("keys"), "evidence")
    return V.score_answers(rows, "answer", "title", "keys", "evidence").drop("title", "answer", "keys", "evidence")


@of_articles("h6_score_answers", f"WITH {ANSWERS} SELECT * REPLACE (round(term_recall, 6) AS term_recall, round(evidence_recall, 6) AS evidence_recall) FROM sa")
def h6(a):
    return six(scored_answers(a))
