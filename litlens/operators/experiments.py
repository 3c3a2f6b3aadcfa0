"""Topic models and their experiments (E1, E2, E19, E20), golden titles (F9), repeated samples
and expected lists (F16, F18), answer rates (H8), systems on one golden set (H9)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions import vectors as V
from litlens.operators import evaluate as EV
from litlens.operators import merging as M
from litlens.operators import neighbours as NN
from litlens.operators import topics as E
from litlens.operators.tables import cut


def kmeans_topics(df: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(id, topic): k topics by cosine k-means over the usable vectors."""
    rows = df.filter(V.valid_vector(F.col("embedding"))).select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = KMeans(k=k, featuresCol="v", predictionCol="topic", distanceMeasure="cosine", seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select("id", "topic")


def run_experiments(df: DataFrame, configs: list[tuple[float, float]]) -> DataFrame:
    """One summary row a configuration (outlier threshold, merge threshold): reassign, merge, measure. Outliers are compared
    with the centroids once; centroids and sizes of all outlier thresholds come from one aggregation each, keyed by threshold and
    cluster; one forest over all of them is cut at every merge threshold."""
    spark = df.sparkSession
    firsts = sorted({r for r, _ in configs})
    known = df.filter("embedding IS NOT NULL").select("id", "cluster_id", "embedding")
    near = E.nearest_centroid(known.filter("cluster_id = -1").select("id", V.l2_normalize(F.col("embedding")).alias("v")), V.centroids(df, "cluster_id", "embedding"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(r)).alias("r")) for i, r in enumerate(firsts)])).alias("x")
    moved = cut(known.join(near, "id", "left").select("id", "cluster_id", "embedding", "nearest", "similarity", each))
    # a cluster of one threshold: its number in the upper bits
    label = F.when((F.col("cluster_id") == -1) & (F.col("similarity") >= F.col("x.r")), F.col("nearest")).otherwise(F.col("cluster_id"))
    moved = moved.select(F.col("x.i").alias("i"), label.cast("long").alias("cluster_id"), "embedding").filter("cluster_id IS NOT NULL")
    key = F.shiftleft(F.col("i").cast("long"), 32) + F.col("cluster_id")
    sizes = cut(moved.groupBy("i", "cluster_id").agg(F.count(F.lit(1)).alias("n")))
    centres = cut(V.centroids(moved.filter("cluster_id >= 0").select(key.alias("k"), "embedding"), "k", "embedding"))
    pairs = NN.pairs_within(NN.unit_rows(centres, "k", "centroid"), min(m for _, m in configs)).filter(F.shiftright("a", 32) == F.shiftright("b", 32))
    merged = M.cuts(M.forest(pairs), [(run, m) for run, (_, m) in enumerate(configs)])
    runs = spark.createDataFrame([(run, firsts.index(r), float(r), float(m)) for run, (r, m) in enumerate(configs)], "run int, i int, reassign double, merge double")
    rows = sizes.join(runs, "i").withColumn("node", F.when(F.col("cluster_id") >= 0, key))
    rows = rows.join(merged.select(F.col("g").alias("run"), "node", "label"), ["run", "node"], "left")
    topics = rows.groupBy("run", "reassign", "merge", F.when(F.col("cluster_id") >= 0, F.coalesce("label", "node")).alias("topic")).agg(F.sum("n").alias("n"))
    docs, out = F.sum("n"), F.coalesce(F.sum(F.when(F.col("topic").isNull(), F.col("n"))), F.lit(0))
    top = F.max(F.when(F.col("topic").isNotNull(), F.col("n")))
    return topics.groupBy("run", "reassign", "merge").agg(docs.alias("docs"), F.count("topic").alias("topics"), out.alias("outliers"), F.round(out / docs, 6).alias("outlier_ratio"), top.alias("largest"), F.round(top / (docs - out), 6).alias("largest_ratio"))


def best_experiment(df: DataFrame) -> DataFrame:
    """The best run by coverage, outlier ratio, Davies-Bouldin, silhouette and largest cluster; a missing or zero value
    counts as 0, 0, infinity, -1 and 1. Ties go to the first run."""
    known = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(other))
    order = [F.desc(known("coverage", 0.0)), known("outlier_ratio", 0.0), known("davies_bouldin", float("inf")), F.desc(known("silhouette", -1.0)), known("largest_ratio", 1.0), F.col("run")]
    return df.orderBy(*order).limit(1)


def multi_run(df: DataFrame, runs: int, n: int) -> DataFrame:
    """F16: mean and population deviation of the direct match over repeated samples of n rows, drawn by a hash of run and id."""
    drawn = lambda r: df.orderBy(F.md5(F.concat_ws(":", F.lit(str(r)), "id")), "id").limit(n).agg(F.avg((F.col("label") == F.col("cluster_id")).cast("double")).alias("m"))
    each = reduce(DataFrame.unionByName, [drawn(r) for r in range(runs)])
    return each.agg(F.round(F.avg("m"), 6).alias("direct_match_mean"), F.round(F.stddev_pop("m"), 6).alias("direct_match_std"))


def compare_expected(expected: DataFrame, articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(title, expected_cluster_id, id, cluster_id, topic, is_match) of an expected list; of several articles with a title
    the one with the smallest id counts. Without one, id is null and nothing matches."""
    first = articles.groupBy(F.lower("title").alias("_t")).agg(F.min(F.struct("id", "cluster_id")).alias("_a"))
    found = expected.join(first, F.lower(expected["title"]) == F.col("_t"), "left").select("title", "expected_cluster_id", "_a.id", "_a.cluster_id")
    named = found.join(clusters.select("cluster_id", F.col("cluster_description").alias("topic")), "cluster_id", "left")
    return named.select("title", "expected_cluster_id", "id", "cluster_id", "topic", F.coalesce(F.col("cluster_id") == F.col("expected_cluster_id"), F.lit(False)).alias("is_match"))


def expected_counts(compared: DataFrame) -> DataFrame:
    """accuracy is among the found ones, null where none is found."""
    found, right = F.count("id"), F.count_if("is_match")
    return compared.agg(F.count(F.lit(1)).alias("expected"), found.alias("found"), right.alias("correct"), F.round(F.when(found > 0, right / found), 6).alias("accuracy"))


def compare_systems(golden: DataFrame, runs: dict[str, DataFrame], k: int) -> DataFrame:
    """H9: (system, mean_mrr, mean_recall, questions) of rankings (question_id, id, rank) against one golden set (question_id,
    expected); a question without a hit counts 0."""
    scored = [EV.score_retrieval(golden, df, k).withColumn("system", F.lit(name)) for name, df in runs.items()]
    return reduce(DataFrame.unionByName, scored).groupBy("system").agg(F.avg("mrr").alias("mean_mrr"), F.avg("recall_at_k").alias("mean_recall"), F.count(F.lit(1)).alias("questions"))


def clean_title(c: Column) -> Column:
    """Letters a-z, digits and single blanks of a title, in lower case."""
    plain = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(r"$\pi$"), F.lit("")), r"[^a-zA-Z0-9\s]", "")
    return F.btrim(F.regexp_replace(F.lower(plain), r"\s+", " "))


#: Lengths of the letter runs by which titles are found that hold a text: the largest that fits, shorter texts as a whole.
RUNS = (30, 12, 8, 5)
#: Longest words of a needle that are looked for, rarest runs of it that a title must hold, ids of a title that can matter.
WORDS, PICKED, FIRST = 4, 2, 5


def _run(at: Column | str, size: Column | str) -> Column:
    """Hash of `size` UTF-16 units of the bytes `units` from place `at` on; places in bytes are found without a walk over letters."""
    return F.xxhash64(F.expr(f"substring(units, 2 * {at} + 1, 2 * {size})"))


def run_keys(needles: DataFrame) -> DataFrame:
    """(nid, kind, size, key) of needles (nid, kind, texts array): hashes of runs that a title with all the texts must hold."""
    units = needles.select("nid", "kind", F.explode("texts").alias("x")).filter("x <> ''").select("nid", "kind", F.encode("x", "UTF-16BE").alias("units"))
    n = F.expr("cast(octet_length(units) div 2 as int)")
    sized = units.withColumn("n", n).withColumn("size", F.coalesce(*[F.when(F.col("n") >= r, r) for r in RUNS], F.col("n")))
    places = sized.withColumn("at", F.explode(F.expr("array_union(sequence(0, n - size, size), array(n - size))")))
    return places.select("nid", "kind", "size", _run("at", "size").alias("key")).distinct()


def holders(needles: DataFrame, titles: DataFrame) -> DataFrame:
    """(nid, tid): titles (tid, t) that may hold all texts of a needle (nid, kind, texts array): those with its `PICKED` rarest
    runs. A title without one of them can't hold the needle, so nothing is missed. Of the titles' runs only those that are looked
    for leave their task: 8 bytes for each run that is looked for go to every task."""
    asked = cut(run_keys(needles))
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())  # 8 numbers at most
    if not sizes:
        return asked.select("nid", F.lit(None).cast("long").alias("tid")).limit(0)
    units = titles.select("tid", F.encode("t", "UTF-16BE").alias("units"))
    some = []
    for size in sizes:
        runs = units.filter(F.octet_length("units") >= 2 * size).select("tid", "units", F.explode(F.expr(f"sequence(0, cast(octet_length(units) div 2 as int) - {size})")).alias("at"))
        keys = asked.filter(F.col("size") == size).select("key").distinct()
        some.append(runs.select("tid", _run("at", size).alias("key")).join(F.broadcast(keys), "key", "left_semi"))
    found = cut(reduce(DataFrame.union, some).distinct())
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = asked.select("nid", "kind", "key").distinct().join(counts, "key", "left").groupBy("nid", "kind")
    rarest = ranked.agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))), 1, PICKED).alias("keys"))
    picked = rarest.select("nid", "kind", F.size("keys").alias("m"), F.explode("keys.key").alias("key"))
    met = picked.join(found, "key").groupBy("nid", "kind", "tid").agg((F.count(F.lit(1)) == F.max("m")).alias("whole"))
    return met.filter("whole").select("nid", "tid").distinct()


def match_golden(golden: DataFrame, articles: DataFrame) -> DataFrame:
    """(gold_id, id, stage) of golden rows (gold_id, article_id string, title): by id, else by the title without regard to
    case, else by its first 30 characters, else by all its words of over four letters (of the first five such articles). In the
    last two, one cleaned title must hold the other. Of several articles the smallest id counts; a row that none fits has a null
    id. Signs in a title stand for themselves. Equal titles, of articles and of golden rows, are one. What the first two stages
    leave meets only the titles with its rarest letter runs."""
    rows = golden.select("gold_id", F.btrim(F.coalesce("title", F.lit(""))).alias("title"), F.expr("try_cast(btrim(article_id) AS BIGINT)").alias("wanted"))
    by_id = articles.select("id", F.col("id").alias("wanted")).distinct()
    first = articles.filter("title IS NOT NULL AND id IS NOT NULL").select("id", "title")
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("title").orderBy("id"))).filter(F.col("nth") <= FIRST)
    titles = first.groupBy("title").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # FIRST ids at most
    titles = cut(titles.select(F.monotonically_increasing_id().alias("tid"), "title", "ids"))
    by_title = titles.groupBy(F.lower("title").alias("_t")).agg(F.min(F.col("ids")[0]).alias("same_title"))
    exact = rows.join(by_id, "wanted", "left").join(by_title, F.lower(rows["title"]) == F.col("_t"), "left")
    exact = cut(exact.select("gold_id", "title", F.coalesce("id", F.when(F.col("title") != "", F.col("same_title"))).alias("id"), F.when(F.col("id").isNotNull(), "id").when((F.col("title") != "") & F.col("same_title").isNotNull(), "exact").alias("stage")))
    low = F.lower("title")
    words = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 4))
    asked = exact.filter("id IS NULL AND title <> ''").select("title").distinct()
    asked = cut(asked.select(F.monotonically_increasing_id().alias("nid"), F.col("title").alias("asked"), F.lower(F.substring("title", 1, 30)).alias("prefix"), words.alias("words"), clean_title(F.col("title")).alias("clean")))
    longest = F.transform(F.slice(F.sort_array(F.transform("words", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1, WORDS), lambda x: x["w"])
    needles = asked.select("nid", F.lit("prefix").alias("kind"), F.array("prefix").alias("texts")).unionByName(asked.select("nid", F.lit("words").alias("kind"), longest.alias("texts")))
    met = holders(needles, titles.select("tid", F.lower("title").alias("t"))).join(titles.select("tid", "ids", low.alias("t"), clean_title(F.col("title")).alias("c")), "tid").join(asked, "nid")
    near, worded = F.col("t").contains(F.col("prefix")), (F.size("words") > 0) & F.forall("words", lambda w: F.col("t").contains(w))
    holds = F.col("c").contains(F.col("clean")) | F.col("clean").contains(F.col("c"))
    met = met.select("nid", "ids", (near & holds).alias("near"), worded.alias("worded"), holds.alias("holds")).filter("near OR worded")
    # the smallest of each kind decide, the others go before the shuffle
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("nid", "near", "worded").orderBy(F.col("ids")[0]))).filter(F.col("nth") <= FIRST)
    met = cut(met.drop("nth"))
    p = met.filter("near").groupBy("nid").agg(F.min(F.col("ids")[0]).alias("p"))
    some = met.filter("worded").select("nid", F.explode("ids").alias("id"), "holds")
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("nid").orderBy("id"))).filter(F.col("nth") <= FIRST)
    k = some.filter("holds").groupBy("nid").agg(F.min("id").alias("k"))
    fuzzy = asked.select("nid", F.col("asked").alias("title")).join(p, "nid", "left").join(k, "nid", "left").drop("nid")
    late = F.when(F.col("p").isNotNull(), "prefix").when(F.col("k").isNotNull(), "words")
    return exact.join(fuzzy, "title", "left").select("gold_id", F.coalesce("id", "p", "k").alias("id"), F.coalesce("stage", late, F.lit("not found")).alias("stage"))


def summarize_answers(df: DataFrame) -> DataFrame:
    """H8: rates and means over scored answers."""
    rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6)
    return df.agg(F.count(F.lit(1)).alias("question_count"), rate("retrieval_hit").alias("retrieval_hit_rate"), rate("title_mentioned").alias("expected_title_mention_rate"), rate("term_recall").alias("mean_key_term_coverage"), rate("citation_marker_count").alias("mean_citation_marker_count"), rate("has_sources_section").alias("sources_section_rate"))


