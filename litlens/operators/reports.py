"""Dashboard, bulletin and digest tables (I): one scan each where the usual service asks once per number or per cluster."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlens.operators.tables import cut

PERIODS = {"3m": 90, "6m": 180, "12m": 365, "all": None}
#: Cluster colours by id.
COLORS = ("#10b981", "#3b82f6", "#f59e0b", "#ef4444", "#8b5cf6", "#ec4899", "#14b8a6", "#6366f1", "#06b6d4", "#f43f5e", "#059669", "#2563eb", "#d97706", "#dc2626", "#7c3aed", "#db2777", "#0d9488", "#4f46e5", "#0891b2", "#e11d48")


def days_before(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY")


def in_category(category: str) -> Column:
    """Equal primary category, or a listed one by ILIKE; % and _ in the value are wildcards."""
    return (F.col("primary_category") == category) | F.col("categories").ilike(f"%{category}%")


def dashboard_filter(df: DataFrame, as_of: str, source: str | None = None, category: str | None = None, period: str = "12m") -> DataFrame:
    """Rows without a date pass only the period `all`."""
    if source:
        df = df.filter(F.col("source") == source)
    if category:
        df = df.filter(in_category(category))
    days = PERIODS.get(period.strip().lower(), PERIODS["12m"])
    return df if days is None else df.filter(F.col("publish_date") >= days_before(as_of, days))


def kpis(df: DataFrame, as_of: str) -> DataFrame:
    """I2"""
    clustered, active = F.count("cluster_id"), F.count_distinct("cluster_id")
    return df.agg(F.count(F.lit(1)).alias("total_papers"), active.alias("active_clusters"), F.when(active > 0, clustered / active).otherwise(0.0).alias("avg_papers_per_cluster"), F.count_if(F.col("publish_date") >= days_before(as_of, 7)).alias("weekly_picks"), clustered.alias("clustered_papers"), F.count("pdf_url").alias("pdf_available"))


def cluster_counts(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """I3"""
    n = df.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("paper_count"))
    return clusters.join(n, "cluster_id")


def color(cluster_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COLORS)), (F.abs(cluster_id) % len(COLORS) + 1).cast("int"))


def cluster_cards(df: DataFrame) -> DataFrame:
    """Name, keyword (first comma part, else first word) and colour."""
    desc, cid = F.coalesce("cluster_description", F.lit("")), F.col("cluster_id").cast("string")
    first = F.btrim(F.when(desc.contains(","), F.split_part(desc, F.lit(","), F.lit(1))).otherwise(F.split_part(desc, F.lit(" "), F.lit(1))))
    return df.select(*df.columns, F.coalesce(F.nullif(desc, F.lit("")), F.concat(F.lit("Cluster "), cid)).alias("name"), F.coalesce(F.nullif(first, F.lit("")), F.concat(F.lit("Topic "), cid)).alias("keyword"), color(F.col("cluster_id")).alias("color"))


def top_clusters(clusters: DataFrame, n: int = 8) -> DataFrame:
    return clusters.orderBy(F.desc("article_count"), "cluster_id").limit(n)


def month_key(c: str = "publish_date") -> Column:
    return F.date_format(F.col(c), "yyyy-MM")


def monthly_counts(df: DataFrame, months: int = 12) -> DataFrame:
    """The last months that have papers."""
    n = df.filter("publish_date IS NOT NULL").groupBy(month_key().alias("month_key")).agg(F.count(F.lit(1)).alias("count"))
    return n.orderBy(F.desc("month_key")).limit(months)


def source_distribution(df: DataFrame) -> DataFrame:
    """I6"""
    return df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("count"))


def category_distribution(df: DataFrame, n: int = 20) -> DataFrame:
    """I7"""
    return df.groupBy(F.coalesce("primary_category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category").limit(n)


def cluster_trends(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """I8: (cluster_id, month_key, count) of the eight largest clusters."""
    top = top_clusters(clusters).select("cluster_id")
    rows = df.filter("publish_date IS NOT NULL").join(F.broadcast(top), "cluster_id", "left_semi")  # eight rows
    return rows.groupBy("cluster_id", month_key().alias("month_key")).agg(F.count(F.lit(1)).alias("count"))


def trends_wide(series: DataFrame) -> DataFrame:
    """I8: counts per month as a map, with the total."""
    return series.groupBy("month_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cluster_id", "count")))).alias("clusters"), F.sum("count").alias("total"))


def acceleration(now: Column, before: Column) -> Column:
    return (now - before) / F.greatest(before, F.lit(1))


def rising_topics(df: DataFrame, clusters: DataFrame, as_of: str, n: int = 8) -> DataFrame:
    """One aggregation with six conditional counts for all clusters; the period filter of the dashboard doesn't apply."""
    d, aggs = F.col("publish_date"), []
    for days in (7, 30, 90):
        last, prev = days_before(as_of, days), days_before(as_of, 2 * days)
        aggs += [F.count_if(d >= last).alias(f"last_{days}d"), F.count_if((d >= prev) & (d < last)).alias(f"prev_{days}d")]
    counts = df.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(*aggs)
    j = clusters.join(counts, "cluster_id", "left").fillna(0, [f"{p}_{k}d" for k in (7, 30, 90) for p in ("last", "prev")])
    acc = {k: acceleration(F.col(f"last_{k}d"), F.col(f"prev_{k}d")) for k in (7, 30, 90)}
    score = 0.5 * acc[30] + 0.3 * acc[90] + 0.2 * acc[7]
    out = j.withColumns({f"acceleration_{k}d": F.round(a, 4) for k, a in acc.items()} | {"score": F.round(score, 4)})
    out = out.orderBy(F.desc(F.col("last_30d") > 0), F.desc("score"), F.desc("last_30d"), F.desc("article_count"), "cluster_id").limit(n)
    return out.select("cluster_id", F.col("article_count").alias("paper_count"), *[f"{p}_{k}d" for k in (7, 30, 90) for p in ("last", "prev")], *[f"acceleration_{k}d" for k in (7, 30, 90)], "score")


def cluster_quality(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row; outliers are embedded rows without a cluster."""
    has = F.col("embedding").isNotNull()
    a = articles.agg(F.count_if(has).alias("total_with_embedding"), F.count_if(has & F.col("cluster_id").isNull()).alias("outlier_count"), F.count("cluster_id").alias("clustered_papers"))
    c = clusters.agg(F.max(F.struct("article_count", (-F.col("cluster_id")).alias("k"))).alias("top"))
    j = a.crossJoin(c)  # one row each
    rate = lambda x, y: F.when(y > 0, F.round(x / y, 4)).otherwise(0.0)
    return j.select("outlier_count", rate(F.col("outlier_count"), F.col("total_with_embedding")).alias("outlier_ratio"), (-F.col("top")["k"]).alias("largest_cluster_id"), F.coalesce(F.col("top")["article_count"], F.lit(0)).alias("largest_cluster_count"), rate(F.coalesce(F.col("top")["article_count"], F.lit(0)), F.col("clustered_papers")).alias("largest_cluster_ratio"), "clustered_papers", "total_with_embedding")


def paper_cards(df: DataFrame, as_of: str, limit: int = 900) -> DataFrame:
    """I13"""
    year = F.year("publish_date").cast("string")
    venue = F.coalesce(F.nullif("venue", F.lit("")), F.lit("Unknown Venue"))
    ref = F.concat(F.lit("Unknown Authors - "), venue, F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit("")))
    abstract = F.coalesce("abstract_text", F.lit(""))
    short = F.when(F.length(abstract) > limit, F.concat(F.rtrim(F.regexp_replace(F.substring(abstract, 1, limit), r"\s+$", "")), F.lit("..."))).otherwise(abstract)
    return df.select("id", "cluster_id", "title", ref.alias("reference"), short.alias("abstract"), F.coalesce(F.col("publish_date") >= days_before(as_of, 7), F.lit(False)).alias("is_weekly_pick"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.col("pdf_url").isNotNull().alias("has_pdf"))


def report_key(version: str, **params) -> str:
    """I14"""
    return f"{version}:{hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:24]}"


def report_keys(version: str, **params: Column) -> Column:
    """I14 for rows: the keys of text parameters, as report_key() makes them."""
    text = F.concat(F.lit("{"), *[x for i, k in enumerate(sorted(params)) for x in (F.lit(", " * (i > 0) + json.dumps(k) + ": "), _json_text(params[k]))], F.lit("}"))
    return F.concat(F.lit(f"{version}:"), F.substring(F.sha2(text, 256), 1, 24))


def _json_text(c: Column) -> Column:
    """A text in JSON's ASCII form; plain letters only, else an error rather than another key."""
    quoted = F.concat(F.lit('"'), c, F.lit('"'))
    return F.when(c.rlike(r"^[ !#-\[\]-~]*$"), quoted).otherwise(F.raise_error(F.lit("a report parameter needs report_key()")).cast("string"))


def bulletin_filter(df: DataFrame, cluster_id=None, source=None, categories=(), start=None, end=None) -> DataFrame:
    """I16: closed date range, any of the categories."""
    if cluster_id is not None:
        df = df.filter(F.col("cluster_id") == cluster_id)
    if source:
        df = df.filter(F.col("source") == source)
    wanted = sorted({c.strip() for c in categories if c and c.strip()})
    if wanted:
        cond = F.lit(False)
        for c in wanted:
            cond = cond | in_category(c)
        df = df.filter(cond)
    if start:
        df = df.filter(F.col("publish_date") >= F.lit(start).cast("timestamp"))
    return df.filter(F.col("publish_date") <= F.lit(end).cast("timestamp")) if end else df


def cluster_papers(df: DataFrame, representatives: DataFrame, n: int) -> DataFrame:
    """(cluster_id, id, position): a cluster's representatives in their order, then others by id, n in all."""
    reps = representatives.select("cluster_id", "id", F.col("rank").alias("_rep"))
    w = Window.partitionBy("cluster_id").orderBy(F.asc_nulls_last("_rep"), "id")
    j = df.filter("cluster_id >= 0").select("cluster_id", "id").join(reps, ["cluster_id", "id"], "left")
    return j.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).drop("_rep")


def centrality(representatives: DataFrame) -> DataFrame:
    """(cluster_id, id, centrality): the stored score, else one over the position."""
    return representatives.select("cluster_id", "id", F.coalesce("score", 1.0 / F.col("rank")).alias("centrality"))


def digest_articles(df: DataFrame, central: DataFrame, n: int) -> DataFrame:
    """(cluster_id, id, position) by centrality, date, citations."""
    j = df.filter("cluster_id >= 0").join(central, ["cluster_id", "id"], "left")
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.round(F.coalesce("centrality", F.lit(0.0)), 9)), F.desc_nulls_last("publish_date"), F.desc(F.coalesce("citation_count", F.lit(0))), "id")
    return j.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def digest_summary(selected: DataFrame, clusters: DataFrame) -> DataFrame:
    """Template text of each cluster from its selected articles."""
    titles = F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("position", "title"))), lambda s: s["title"]), 1, 3), "; ")
    g = selected.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), titles.alias("titles")).join(clusters, "cluster_id")
    text = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" contains "), F.col("n").cast("string"), F.lit(" selected real articles related to "), F.col("cluster_description"), F.lit(". Representative papers include: "), F.col("titles"), F.lit(". This digest is based only on locally stored article metadata and abstracts."))
    return g.select("cluster_id", text.alias("summary"))


def digest_highlights(selected: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Keywords (of cluster_id, keywords array, the first five), top categories and the most cited selected paper."""
    cats = F.array_join(F.slice(F.array_sort(F.collect_set("primary_category")), 1, 5), ", ")
    cited = F.max(F.when(F.col("citation_count") > 0, F.struct("citation_count", (-F.col("position")).alias("p"), "title")))
    g = selected.groupBy("cluster_id").agg(cats.alias("cats"), cited.alias("cited"))
    g = g.join(keywords.select("cluster_id", F.array_join(F.slice("keywords", 1, 5), ", ").alias("words")), "cluster_id", "left") if keywords is not None else g.withColumn("words", F.lit(None).cast("string"))
    best = F.concat(F.lit("Most cited selected paper: "), F.col("cited")["title"], F.lit(" ("), F.col("cited")["citation_count"].cast("string"), F.lit(" citations)"))
    line = lambda name, c: F.concat(F.lit(name), F.nullif(c, F.lit("")))
    return g.select("cluster_id", F.concat_ws(" | ", line("Keywords: ", F.col("words")), line("Top categories: ", F.col("cats")), best).alias("highlights"))


def bulletin_options(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(kind, value, paper_count): the clusters that have papers and the categories that a user can choose."""
    cats = articles.filter("primary_category IS NOT NULL AND primary_category <> ''").groupBy(F.col("primary_category").alias("value")).agg(F.count(F.lit(1)).alias("paper_count"))
    some = clusters.filter("article_count > 0").select(F.col("cluster_id").cast("string").alias("value"), F.col("article_count").alias("paper_count"))
    return some.select(F.lit("cluster").alias("kind"), "*").unionByName(cats.select(F.lit("category").alias("kind"), "*"))


def user_bulletins(preferences: DataFrame, articles: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """(user_id, cluster_id, id): the first n papers, by ranked (cluster_id, id, rank), of each cluster that a user chose, or
    of the papers in the categories that a user chose, within every cluster. preferences: (user_id, selection_type, cluster_ids
    array, categories array). Papers are ranked once for each cluster and for each category, not for each user."""
    rows = articles.filter("cluster_id >= 0").select("cluster_id", "id", "primary_category").join(ranked.select("cluster_id", "id", "rank"), ["cluster_id", "id"], "left")
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.asc_nulls_last("rank"), "id")
    by_cluster = rows.withColumn("_n", F.row_number().over(order("cluster_id"))).filter(F.col("_n") <= n)
    asked = preferences.filter("selection_type = 'clusters'").select("user_id", F.explode(F.array_distinct("cluster_ids")).alias("cluster_id"))
    mine = asked.join(by_cluster, "cluster_id").select("user_id", "cluster_id", "id")
    by_category = rows.withColumn("_n", F.row_number().over(order("cluster_id", "primary_category"))).filter(F.col("_n") <= n).drop("_n")
    wanted = preferences.filter("selection_type = 'categories'").select("user_id", F.explode(F.array_distinct("categories")).alias("primary_category"))
    # the first n of several categories are among the first n of each
    theirs = wanted.join(by_category, "primary_category")
    theirs = theirs.withColumn("_n", F.row_number().over(order("user_id", "cluster_id"))).filter(F.col("_n") <= n).select("user_id", "cluster_id", "id")
    return mine.unionByName(theirs)


def weekly_best(df: DataFrame, scores: DataFrame, as_of: str, n: int = 6, each: int = 2) -> DataFrame:
    """(part, cluster_id, id, score, position): the week's best n papers by score; then for each cluster that has papers of the
    week, the first `each` of them by score."""
    week = df.filter(F.col("publish_date") >= days_before(as_of, 7)).join(scores.select("id", F.col("score").alias("_s")), "id", "left")
    week = week.select("cluster_id", "id", F.coalesce("_s", F.lit(0.8)).alias("score"))
    order = [F.desc(F.round("score", 9)), F.col("id")]
    best = week.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))  # n rows
    shown = week.filter("cluster_id >= 0").withColumn("position", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).filter(F.col("position") <= each)
    return best.select(F.lit("best").alias("part"), "*").unionByName(shown.select(F.lit("cluster").alias("part"), "*"))


def facets(articles: DataFrame, as_of: str, source: str | None = None, category: str | None = None, period: str = "12m") -> DataFrame:
    """(kind, cluster_id, month_key, source, category, n, weekly, clustered, pdf): all counts of the dashboard from one
    scan and one aggregation by grouping sets. Rows of the source facet disregard the filter on the source, those of the category
    facet the one on the category. kind: all, cluster, month, source or category."""
    named = F.lit(True) if not source else F.coalesce(F.col("source") == source, F.lit(False))
    listed = F.lit(True) if not category else F.coalesce(in_category(category), F.lit(False))
    rows = dashboard_filter(articles, as_of, period=period).filter(named | listed).select(
        "cluster_id", month_key().alias("month_key"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("primary_category", F.lit("unknown")).alias("category"),
        named.alias("_named"), listed.alias("_listed"), (F.col("publish_date") >= days_before(as_of, 7)).alias("_week"), F.col("pdf_url").isNotNull().alias("_pdf"),
    )
    keys = ("cluster_id", "month_key", "source", "category")
    shown, asked = F.col("_named") & F.col("_listed"), [F.grouping(k).alias(f"_g_{k}") for k in keys]
    sets = rows.groupingSets([[], *[[F.col(k)] for k in keys]], *keys).agg(*asked, F.count_if(shown).alias("_all"), F.count_if("_listed").alias("_by_source"), F.count_if("_named").alias("_by_category"), F.count_if(shown & F.col("_week")).alias("weekly"), F.count_if(shown & F.col("_pdf")).alias("pdf"))
    kind = F.when(F.col("_g_cluster_id") == 0, "cluster").when(F.col("_g_month_key") == 0, "month").when(F.col("_g_source") == 0, "source").when(F.col("_g_category") == 0, "category").otherwise("all")
    n = F.when(kind == "source", F.col("_by_source")).when(kind == "category", F.col("_by_category")).otherwise(F.col("_all"))
    return sets.select(kind.alias("kind"), *keys, n.alias("n"), "weekly", "pdf")


def dashboard(articles: DataFrame, clusters: DataFrame, as_of: str, source: str | None = None, category: str | None = None, period: str = "12m") -> dict[str, DataFrame]:
    """The tables of the dashboard by name, all from the one table of facets, which has a row a value."""
    f = cut(facets(articles, as_of, source, category, period))
    of = lambda kind: f.filter(F.col("kind") == kind)
    cluster = of("cluster").filter("cluster_id IS NOT NULL AND n > 0")
    active = cluster.agg(F.count(F.lit(1)).alias("active_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("clustered_papers"))
    per = F.when(F.col("active_clusters") > 0, F.col("clustered_papers") / F.col("active_clusters")).otherwise(0.0)
    total = of("all").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_papers"), F.coalesce(F.sum("weekly"), F.lit(0)).alias("weekly_picks"), F.coalesce(F.sum("pdf"), F.lit(0)).alias("pdf_available"))
    kpi = total.crossJoin(active).select("total_papers", "active_clusters", per.alias("avg_papers_per_cluster"), "weekly_picks", "clustered_papers", "pdf_available")  # one row each
    months = of("month").filter("month_key IS NOT NULL AND n > 0").select("month_key", F.col("n").alias("count")).orderBy(F.desc("month_key")).limit(12)
    return {
        "kpis": kpi, "cluster_counts": clusters.join(cluster.select("cluster_id", F.col("n").alias("paper_count")), "cluster_id"), "monthly_counts": months,
        "sources": of("source").filter("n > 0").select("source", F.col("n").alias("count")),
        "categories": of("category").filter("n > 0").select("category", F.col("n").alias("count")).orderBy(F.desc("count"), "category").limit(20), "pie": top_clusters(clusters),
    }


def digest_sources(selected: DataFrame, central: DataFrame) -> DataFrame:
    """The selected articles of each digest, in its order, as S1 to Sn with their centrality (0 without one)."""
    score = central.select("cluster_id", "id", F.col("centrality").alias("_c"))
    rows = selected.join(score, ["cluster_id", "id"], "left")
    return rows.select("cluster_id", F.concat(F.lit("S"), F.col("position").cast("string")).alias("source_id"), F.col("id").alias("article_id"), "title", F.coalesce("_c", F.lit(0.0)).alias("centrality_score"))
