"""Retrieval over article tables: filters, search terms, vector search for a table of queries, fusion (G)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions import vectors as V
from litlens.operators.reports import in_category  # noqa: F401

#: Words that are no search terms.
QUERY_STOP = ("about", "adli", "arada", "article", "articles", "ayari", "bir", "bu", "called", "fine", "hangi", "makale", "makaleler", "named", "paper", "papers", "sistem", "sistemi", "sistemini", "sunum", "the", "ve", "which")
#: Turkish letters and their plain forms.
TURKISH, PLAIN = "çğıöşüÇĞİÖŞÜ", "cgiosucgiosu"
K1, B, TITLE_WEIGHT = 1.2, 0.75, 3.0


@dataclass(frozen=True)
class Filters:
    article_ids: tuple[int, ...] = ()
    source: str | None = None
    cluster_id: int | None = None
    primary_category: str | None = None
    categories_any: tuple[str, ...] = ()
    venue: str | None = None
    doi: str | None = None
    has_pdf: bool | None = None
    min_citation_count: int | None = None
    publish_date_from: str | None = None
    publish_date_to: str | None = None


def predicate(f: Filters) -> Column:
    """G1: one predicate from all set fields; text fields by ILIKE, where % and _ of the value are wildcards; whole days."""
    out = F.lit(True)
    if f.article_ids:
        out = out & F.col("id").isin(*f.article_ids)
    for name in ("source", "cluster_id", "primary_category"):
        if getattr(f, name) not in (None, ""):
            out = out & (F.col(name) == getattr(f, name))
    if f.categories_any:
        some = F.lit(False)
        for c in f.categories_any:
            some = some | F.col("categories").ilike(f"%{c}%")
        out = out & some
    for name in ("venue", "doi"):
        if getattr(f, name):
            out = out & F.col(name).ilike(f"%{getattr(f, name)}%")
    if f.has_pdf is not None:
        out = out & (F.col("pdf_url").isNotNull() if f.has_pdf else F.col("pdf_url").isNull())
    if f.min_citation_count is not None:
        out = out & (F.col("citation_count") >= f.min_citation_count)
    if f.publish_date_from:
        out = out & (F.col("publish_date") >= F.lit(f.publish_date_from).cast("timestamp"))
    if f.publish_date_to:
        out = out & (F.col("publish_date") < F.lit(f.publish_date_to).cast("timestamp") + F.expr("INTERVAL '1' DAY"))
    return out


def latest(df: DataFrame, f: Filters, n: int) -> DataFrame:
    """G2"""
    return df.filter(predicate(f) & F.col("publish_date").isNotNull()).orderBy(F.desc("publish_date"), F.desc("id")).limit(n)


def lookup(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (pos, id) in the asked order."""
    return ids.join(df, "id").orderBy("pos")


def top(df: DataFrame, order: list, n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def vector_search(articles: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """G4, batch: (query_id, id, score, rank), score = max(0, cosine). Queries (query_id, vector) come in blocks of about 64,
    one array a block, so each article row meets a block of queries at once and keeps its scores; per task the best are kept
    before the shuffle (the rank limit is pushed down)."""
    blocks = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(max(1, queries.count() // 64)))).groupBy("_b").agg(F.collect_list(F.struct("query_id", V.l2_normalize(F.col("vector")).alias("v"))).alias("qs"))
    rows = articles.filter("embedding IS NOT NULL").select("id", V.l2_normalize(F.col("embedding")).alias("u")).crossJoin(blocks)
    scored = rows.select("id", F.explode(F.transform("qs", lambda q: F.struct(q["query_id"].alias("query_id"), F.greatest(F.lit(0.0), V.dot(F.col("u"), q["v"])).alias("score")))).alias("s"))
    return top(scored.select("s.query_id", "id", "s.score"), [F.desc(F.round("score", 9)), "id"], n)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_terms(c: Column) -> Column:
    """Tokens without dots and dashes at the ends, Turkish letters plain, lower case; at least three letters unless upper
    case; no stop words; distinct, the first eight."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_.\-]{2,}"), F.lit(0))
    plain = lambda t: F.lower(F.translate(F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""), TURKISH, PLAIN))
    shouted = lambda t: (F.upper(t) == t) & (F.lower(t) != t)
    kept = F.filter(tokens, lambda t: ((F.length(plain(t)) >= 3) | shouted(t)) & ~plain(t).isin(*QUERY_STOP))
    return F.slice(F.array_distinct(F.transform(kept, plain)), 1, 8)


def keyword_score(title: Column, abstract: Column, terms: Column) -> Column:
    """Hits of whole terms (three a title hit, one an abstract hit), 1 and 0.25 for containment."""
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    whole = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}_])"))
    one = lambda x: 3.0 * F.regexp_count(t, whole(x)) + F.regexp_count(a, whole(x)) + F.when(t.contains(x), 1.0).otherwise(0.0) + F.when(a.contains(x), 0.25).otherwise(0.0)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + one(x))


def identity_key() -> Column:
    """G12"""
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(F.btrim(F.nullif("doi", F.lit(""))))), F.concat(F.lit("external:"), F.col("source"), F.lit(":"), F.col("external_id")))


def merge_candidates(vector: DataFrame, bm25: DataFrame) -> DataFrame:
    """Candidates (query_id, key, id, score, rank) of both retrievers by identity; the worse rank of a key stays, and the
    article that came first."""
    side = lambda df, name: df.groupBy("query_id", "key").agg(F.min_by("id", "rank").alias(f"{name}_id"), F.max("rank").alias(f"{name}_rank"), F.max_by("score", "rank").alias(f"{name}_score"))
    j = side(vector, "vector").join(side(bm25, "bm25"), ["query_id", "key"], "full")
    source = F.when(F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNotNull(), "both").when(F.col("vector_rank").isNotNull(), "vector").otherwise("bm25")
    return j.withColumns({"id": F.coalesce("vector_id", "bm25_id"), "retrieval_source": source}).drop("vector_id", "bm25_id")


def fusion_order() -> list[Column]:
    return [F.desc(F.round("fusion_score", 9)), F.desc(F.round(F.coalesce("vector_score", F.lit(0.0)), 9)), F.desc(F.round(F.coalesce("bm25_score", F.lit(0.0)), 9)), F.col("id")]


def fuse_rrf(merged: DataFrame, k: int = 60) -> DataFrame:
    """G14"""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    out = merged.withColumn("fusion_score", part("vector_rank") + part("bm25_rank"))
    return out.withColumn("fusion_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion_order())))


def fuse_weighted(merged: DataFrame, alpha: float = 0.65) -> DataFrame:
    """Min-max per side and query; one distinct value (sums may differ in their last digits) counts 1, a missing one 0."""
    alpha, w = min(1.0, max(0.0, alpha)), Window.partitionBy("query_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(F.col(c).isNull(), 0.0).when(high - low < 1e-9, 1.0).otherwise((F.col(c) - low) / (high - low))

    out = merged.withColumn("fusion_score", alpha * scaled("vector_score") + (1 - alpha) * scaled("bm25_score"))
    return out.withColumn("fusion_rank", F.row_number().over(w.orderBy(*fusion_order())))


def final_score(similarity: Column, as_of: str) -> Column:
    """Recency (whole days elapsed), citations, missing abstract."""
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("publish_date")) / 86400))
    fresh = F.when(F.col("publish_date").isNotNull(), F.greatest(F.lit(0.0), 0.05 * (1 - F.least(age, F.lit(365)) / 365))).otherwise(0.0)
    cited = F.when(F.col("citation_count") > 0, F.least(F.lit(0.03), F.log10(F.col("citation_count") + 1) / 100)).otherwise(0.0)
    empty = F.when(F.btrim(F.coalesce("abstract_text", F.lit(""))) == "", 0.05).otherwise(0.0)
    return similarity + fresh + cited - empty


def keyword_component(score: Column) -> Column:
    """G17"""
    return F.when(score > 0, F.least(F.lit(0.65), F.log1p(score) / 5)).otherwise(0.0)


def dedupe_best(df: DataFrame, score: str, order: str = "id") -> DataFrame:
    """G18"""
    w = Window.partitionBy(identity_key()).orderBy(F.desc(F.round(score, 9)), order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedupe_first(df: DataFrame, order: str = "id") -> DataFrame:
    """G19"""
    w = Window.partitionBy(identity_key()).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def normalize_decision(df: DataFrame) -> DataFrame:
    """top_k between 1 and 10, known sort orders, lower source."""
    sort = F.when(F.col("sort_by").isin("relevance", "publish_date_desc"), F.col("sort_by")).otherwise("relevance")
    return df.withColumns({"top_k": F.greatest(F.lit(1), F.least(F.lit(10), "top_k")), "sort_by": sort, "source": F.nullif(F.lower(F.btrim("source")), F.lit(""))})
