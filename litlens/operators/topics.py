"""Topic tables: outlier reassignment, cluster merging, keywords, profiles (E)."""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions import text as T
from litlens.functions import vectors as V
from litlens.operators import merging as M
from litlens.operators import neighbours as NN
from litlens.operators.tables import cut


def english_stop_words() -> tuple[str, ...]:
    """Spark's own English list, read from the file that ships with it (its contractions are no words here)."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for folder in (os.path.join(home, "jars"), os.path.join(os.path.dirname(pyspark.__file__), "jars")):
        for jar in sorted(glob.glob(os.path.join(folder, "spark-mllib_*.jar"))):
            with zipfile.ZipFile(jar) as z:
                words = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()
            return tuple(w for w in words if "'" not in w)
    raise FileNotFoundError("Spark's list of English stop words")


#: Common words of other languages, our own choice.
OTHER_WORDS = ("le", "la", "les", "de", "des", "et", "un", "une", "der", "die", "das", "und", "el", "los", "las", "en", "que")
COMMON_WORDS = english_stop_words() + OTHER_WORDS
#: Academic words that name no topic, and further generic research words.
ACADEMIC_WORDS = ("paper", "study", "approach", "method", "methods", "result", "results", "show", "shows", "shown", "propose", "proposed", "present", "presented", "using", "use", "used", "based", "problem", "task", "performance", "new", "novel", "work", "framework", "experiments", "experimental", "analysis", "demonstrate", "demonstrates", "significant", "effective", "efficient", "deep", "learning")
RESEARCH_WORDS = ("model", "models", "data", "dataset", "datasets", "learning", "algorithm", "algorithms")
STOP_WORDS = COMMON_WORDS + ACADEMIC_WORDS
GENERIC_WORDS = ACADEMIC_WORDS + RESEARCH_WORDS


#: Up to so many centroids go to every task.
MOST_CENTROIDS = 4096


def nearest_centroid(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, nearest, similarity) of rows (id, v unit vector) and centroids (cluster_id, centroid); ties go to the smaller label. Few
    centroids are read as one array; more are searched by cells, without a join of all pairs."""
    if centroids.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        c = centroids.select(F.col("cluster_id").cast("long").alias("id"), F.col("centroid").alias("v"))
        cells = NN.fit(c)
        assigned = cut(NN.assign(c, cells))
        apart = df.select((-1 - F.col("id").cast("long")).alias("id"), "v")  # no query has a centroid's id
        found = NN.nearest(assigned, apart, NN.measured(cells, assigned), 1, NN.MAX_CELLS)
        return found.select((-1 - F.col("query_id")).alias("id"), F.col("id").cast("int").alias("nearest"), F.col("score").alias("similarity"))
    centre = centroids.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "centroid"))).alias("centres"))
    sims = F.transform("centres", lambda c: F.struct(V.dot(c["centroid"], F.col("v")).alias("s"), (-c["cluster_id"]).alias("k")))
    best = df.crossJoin(F.broadcast(centre)).withColumn("_best", F.array_max(sims))  # one row
    return best.select("id", (-F.col("_best")["k"]).cast("int").alias("nearest"), F.col("_best")["s"].alias("similarity"))


def reassign_outliers(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, cluster_id, new_cluster_id, similarity). An outlier takes the nearest centroid's label if it is near enough;
    ties go to the smaller label."""
    known = df.filter("embedding IS NOT NULL")
    outliers = known.filter("cluster_id = -1").select("id", V.l2_normalize(F.col("embedding")).alias("v"))
    near = nearest_centroid(outliers, V.centroids(df, "cluster_id", "embedding"))
    new = F.when(F.col("similarity") >= threshold, F.col("nearest")).otherwise(F.col("cluster_id"))
    return known.select("id", "cluster_id").join(near, "id", "left").select("id", "cluster_id", new.cast("int").alias("new_cluster_id"), "similarity")


def reassignment_counts(reassigned: DataFrame) -> DataFrame:
    before, after = F.count_if(F.col("cluster_id") == -1), F.count_if(F.col("new_cluster_id") == -1)
    return reassigned.agg(before.alias("outliers_before"), after.alias("outliers_after"), (before - after).alias("reassigned"), F.when(before > 0, (before - after) / before).otherwise(0.0).alias("acceptance"))


def merge_mapping(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(cluster_id, merged_id): clusters whose centroids are similar, transitively; the smallest label wins."""
    c = cut(V.centroids(df, "cluster_id", "embedding"))
    pairs = NN.pairs_within(NN.unit_rows(c, "cluster_id", "centroid"), threshold)
    merged = M.cuts(M.forest(pairs), [(0, threshold)]).select(F.col("node").alias("cluster_id"), F.col("label").cast("int").alias("label"))
    return c.join(merged, "cluster_id", "left").select("cluster_id", F.coalesce("label", "cluster_id").alias("merged_id"))


def merge_close_clusters(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """df with merged_id; outliers stay -1 and unclustered rows null."""
    return df.join(merge_mapping(df, threshold), "cluster_id", "left").withColumn("merged_id", F.coalesce("merged_id", "cluster_id"))


def largest_cluster_ratio(df: DataFrame) -> DataFrame:
    """E10"""
    n = df.filter("cluster_id >= 0").groupBy("cluster_id").count()
    return n.agg((F.max("count") / F.sum("count")).alias("largest_cluster_ratio"))


def topic_run_summary(df: DataFrame) -> DataFrame:
    """One row, ratios rounded to 6."""
    n = df.filter("cluster_id IS NOT NULL").groupBy("cluster_id").count()
    docs, out = F.sum("count"), F.coalesce(F.sum(F.when(F.col("cluster_id") == -1, F.col("count"))), F.lit(0))
    top = F.max(F.when(F.col("cluster_id") >= 0, F.col("count")))
    return n.agg(docs.alias("docs"), F.count_if(F.col("cluster_id") >= 0).alias("topics"), out.alias("outliers"), F.round(out / docs, 6).alias("outlier_ratio"), top.alias("largest"), F.round(top / (docs - out), 6).alias("largest_ratio"))


def default_min_samples(n: Column) -> Column:
    """E3"""
    return F.greatest(F.lit(5), F.least(F.lit(15), F.floor(n / 5).cast("int")))


def tokens_of(text: Column) -> Column:
    """Lower-case words of at least two letters, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def term_rows(rows: DataFrame, text: Column) -> DataFrame:
    """rows (id, cluster_id, and what text reads) as (id, cluster_id, term), one for each uni- and bigram of its text. The words are
    found once a row: an outer explode infers no filter that would find them again."""
    words = rows.select("id", "cluster_id", tokens_of(text).alias("w")).select("id", "cluster_id", "w", F.posexplode_outer("w").alias("at", "one"))
    both = F.array("one", F.concat("one", F.lit(" "), F.get("w", F.col("at") + 1)))
    return words.select("id", "cluster_id", F.explode_outer(both).alias("term")).filter("term IS NOT NULL")


def topic_terms(df: DataFrame, text: Column | None = None, min_docs: int = 2) -> DataFrame:
    """(cluster_id, term, tf): counts of the terms that at least min_docs documents hold, in `text` or else in the
    representation text. Counts are partial before the shuffle; whether two documents hold a term is told by its smallest and
    largest id, so up to min_docs 2 no term is shuffled for each document."""
    text = T.representation_text(F.col("title"), F.col("abstract_text")) if text is None else text
    rows = term_rows(df.filter("cluster_id >= 0"), text)
    if min_docs <= 2:
        low, high, none = F.min("id"), F.max("id"), F.max(F.col("id").isNull())
        docs = F.when((low != high) | (none & low.isNotNull()), 2).otherwise(1)
        tf = rows.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf"), docs.alias("docs"))
    else:
        per_doc = rows.groupBy("id", "cluster_id", "term").agg(F.count(F.lit(1)).alias("n"))
        tf = per_doc.groupBy("cluster_id", "term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("docs"))
    total = tf.withColumn("_df", F.sum("docs").over(Window.partitionBy("term")))
    return total.filter(F.col("_df") >= min_docs).select("cluster_id", "term", "tf")


def ctfidf(terms: DataFrame) -> DataFrame:
    """E5: class TF-IDF, sqrt of the L1-normalised count by ln(1 + mean class length / term total). The terms are made once; class
    lengths are summed before they move, so no class lies in one task."""
    terms = cut(terms)
    lengths = terms.groupBy("cluster_id").agg(F.sum("tf").alias("_len"))
    mean = lengths.agg((F.sum("_len") / F.count("cluster_id")).alias("_mean"))
    sized = terms.withColumn("_all", F.sum("tf").over(Window.partitionBy("term"))).join(lengths, "cluster_id")
    return sized.crossJoin(F.broadcast(mean)).select("cluster_id", "term", (F.sqrt(F.col("tf") / F.col("_len")) * F.log(1 + F.col("_mean") / F.col("_all"))).alias("weight"))  # one row


def topic_keywords(weights: DataFrame, n: int = 10) -> DataFrame:
    """E6"""
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def clean_keywords(words: Column) -> Column:
    """Blanks collapsed, lower case, distinct; without stop and generic words and blanks."""
    low = F.transform(words, lambda w: F.btrim(F.regexp_replace(F.lower(w), r"\s+", " ")))
    return F.array_distinct(F.filter(low, lambda w: (w != "") & ~w.isin(*STOP_WORDS, *GENERIC_WORDS) & ~F.forall(F.split(w, " "), lambda p: p.isin(*STOP_WORDS, *GENERIC_WORDS))))


def valid_topic(words: Column) -> Column:
    """At most half of the first ten keywords are stop words."""
    first = F.slice(words, 1, 10)
    return F.when(F.size(first) > 0, F.size(F.filter(first, lambda w: w.isin(*STOP_WORDS))) / F.size(first) <= 0.5).otherwise(False)


def representatives(df: DataFrame, n: int = 10) -> DataFrame:
    """(cluster_id, id, score, rank) by cosine to the plain mean of the cluster."""
    scored = df.filter("embedding IS NOT NULL").join(V.centroids(df, "cluster_id", "embedding", normalized=False), "cluster_id")
    scored = scored.select("cluster_id", "id", V.cosine(F.col("embedding"), F.col("centroid")).alias("score"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def cluster_categories(df: DataFrame, n: int = 5) -> DataFrame:
    """The most common categories of each cluster (primary one, else the first listed)."""
    cat = F.coalesce(F.nullif(F.btrim("primary_category"), F.lit("")), F.btrim(F.split_part("categories", F.lit(","), F.lit(1))))
    counts = df.filter("cluster_id >= 0").groupBy("cluster_id", cat.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "category")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def cluster_profile(df: DataFrame) -> DataFrame:
    """Size, date range and counts per source of each cluster, with its categories."""
    base = df.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"), F.min("publish_date").alias("first_date"), F.max("publish_date").alias("last_date"), *[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("arxiv", "openalex", "semanticscholar")])
    cats = cluster_categories(df).groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category"))), lambda s: s["category"]), ", ").alias("categories"))
    reps = representatives(df).groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("representative_ids"))
    return base.join(cats, "cluster_id", "left").join(reps, "cluster_id", "left")


def build_clusters(df: DataFrame) -> DataFrame:
    """(cluster_id, name, keywords, article_count): topics whose cleaned keywords are valid; named by them."""
    words = topic_keywords(ctfidf(topic_terms(df))).groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("raw"))
    named = words.filter(valid_topic(F.col("raw"))).withColumn("keywords", clean_keywords(F.col("raw"))).filter(F.size("keywords") > 0)
    n = df.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"))
    return named.join(n, "cluster_id").select("cluster_id", F.array_join("keywords", ", ").alias("name"), "keywords", "article_count")
