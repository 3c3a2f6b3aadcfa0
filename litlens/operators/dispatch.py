"""Retrieval for a table of queries with filters of their own, each answered by its branch only, and its evaluation.

A query row has query_id, vector, terms, mode (hybrid, vector, bm25), sort_by, top_k and the filter fields of FIELDS, null where
not set. Branches: the newest first if it asks for them; a lookup if it names one to five ids; else vector and BM25 search by
its mode, fused. A hybrid query without terms or without hits of one side is answered by the other; a BM25 query without hits
has no answer. The article rows meet the queries as a broadcast table of at most MOST_QUERIES rows at a time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions import vectors as V
from litlens.operators import evaluate as EV
from litlens.operators import lexicon as L
from litlens.operators import routing as RT
from litlens.operators import search as G
from litlens.operators import tables as T

FIELDS = {"article_ids": "array<bigint>", "source": "string", "cluster_id": "int", "primary_category": "string", "categories_any": "array<string>", "venue": "string", "doi": "string", "has_pdf": "boolean", "min_citation_count": "int", "publish_date_from": "timestamp", "publish_date_to": "timestamp"}
#: What the lexical index does not know.
LATE_FIELDS = ("has_pdf", "min_citation_count")
MODES, SORTS = ("hybrid", "vector", "bm25"), ("relevance", "publish_date_desc")
MOST_QUERIES = 4096


def with_fields(queries: DataFrame) -> DataFrame:
    """queries with all columns of a query row, nulls and defaults where there are none; unknown modes are hybrid."""
    kinds = {"vector": "array<double>", "terms": "array<string>", "mode": "string", "sort_by": "string", "top_k": "int", **FIELDS}
    out = queries.select("query_id", *[(F.col(c) if c in queries.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    known = lambda c, some: F.when(F.col(c).isin(*some), F.col(c)).otherwise(some[0])
    return out.withColumns({"mode": known("mode", MODES), "sort_by": known("sort_by", SORTS), "top_k": F.greatest(F.lit(1), F.coalesce("top_k", F.lit(5)))})


def branch() -> Column:
    return F.when(F.col("sort_by") == "publish_date_desc", "latest").when(F.size("article_ids").between(1, 5), "lookup").otherwise(F.col("mode"))


def matches(q: str, early: bool = False) -> Column:
    """G1 with the filters as data: columns of the article row against the struct q. An article without a value fits no filter on
    it. early: only what the lexical index knows."""
    field = lambda f: F.col(f"{q}.{f}")
    fits = {
        "article_ids": (F.coalesce(F.size(field("article_ids")), F.lit(0)) < 1) | F.array_contains(field("article_ids"), F.col("id")),
        **{f: field(f).isNull() | (field(f).cast("string") == "") | (F.col(f) == field(f)) for f in ("source", "cluster_id", "primary_category")},
        "categories_any": (F.coalesce(F.size(field("categories_any")), F.lit(0)) < 1) | F.exists(field("categories_any"), lambda c: F.ilike(F.col("categories"), F.concat(F.lit("%"), c, F.lit("%")))),
        **{f: field(f).isNull() | (field(f) == "") | F.ilike(F.col(f), F.concat(F.lit("%"), field(f), F.lit("%"))) for f in ("venue", "doi")},
        "has_pdf": field("has_pdf").isNull() | (F.col("pdf_url").isNotNull() == field("has_pdf")),
        "min_citation_count": field("min_citation_count").isNull() | (F.col("citation_count") >= field("min_citation_count")),
        "publish_date_from": field("publish_date_from").isNull() | (F.col("publish_date") >= field("publish_date_from")),
        "publish_date_to": field("publish_date_to").isNull() | (F.col("publish_date") < field("publish_date_to") + F.expr("INTERVAL '1' DAY")),
    }
    return reduce(Column.__and__, [F.coalesce(c, F.lit(False)) for f, c in fits.items() if not (early and f in LATE_FIELDS)])


def met(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """Article rows with each query (struct q) whose filters they fit."""
    n = queries.count()
    parts = max(1, math.ceil(n / MOST_QUERIES))
    some = lambda i: queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else queries
    rows = [articles.join(F.broadcast(some(i).select(F.struct(*queries.columns).alias("q"))), matches("q")) for i in range(parts)]
    return reduce(DataFrame.unionByName, rows)


ANSWER = ("query_id", "id", "rank", "retrieval_source", "score")


def latest_branch(articles: DataFrame, queries: DataFrame, candidates: int) -> DataFrame:
    rows = met(articles.filter("publish_date IS NOT NULL"), queries).select("q.query_id", "q.top_k", "id", "publish_date", G.identity_key().alias("key"))
    newest = [F.desc("publish_date"), F.desc("id")]
    first = G.top(rows, newest, candidates, "_n").withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("_n"))).filter("_k = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_n"))).filter(F.col("rank") <= F.col("top_k")).select("query_id", "id", "rank", F.lit("latest").alias("retrieval_source"), F.lit(None).cast("double").alias("score"))


def lookup_branch(articles: DataFrame, queries: DataFrame, as_of: str) -> DataFrame:
    named = queries.select(F.struct(*queries.columns).alias("q"), F.explode(F.array_distinct("article_ids")).alias("id"))
    rows = articles.join(named, "id").filter(matches("q")).select("q.query_id", "q.top_k", "id", G.identity_key().alias("key"), G.final_score(F.lit(0.0), as_of).alias("score"))
    best = [F.desc(F.round("score", 9)), F.col("id")]
    kept = rows.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*best))).filter("_k = 1")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= F.col("top_k")).select("query_id", "id", "rank", F.lit("lookup").alias("retrieval_source"), "score")


def vector_hits(articles: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank) by cosine, 0 at least, among the articles that fit."""
    unit = queries.withColumn("vector", V.l2_normalize(F.col("vector")))
    rows = met(articles.filter(V.valid_vector(F.col("embedding"))).withColumn("_v", V.l2_normalize(F.col("embedding"))), unit)
    return G.top(rows.select("q.query_id", "id", F.greatest(F.lit(0.0), V.dot(F.col("_v"), F.col("q.vector"))).alias("score")), [F.desc(F.round("score", 9)), "id"], n)


def bm25_hits(articles: DataFrame, index: L.StoredIndex, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank): 4 n hits of what the index can narrow, ranked, then all filters; ranks have gaps."""
    asked = queries.select("query_id", F.struct(*queries.columns).alias("q"))
    fits = lambda hits, early: hits.join(articles, "id").join(asked, "query_id").filter(matches("q", early)).select(*hits.columns)
    hits = L.search(index, queries.select("query_id", "terms"), 4 * n, lambda h: fits(h, True))
    return G.top(fits(hits, False), [F.col("rank")], n, "_place").drop("_place")


def dispatch(articles: DataFrame, index: L.StoredIndex, queries: DataFrame, as_of: str, candidates: int = 25) -> DataFrame:
    """(query_id, id, rank, retrieval_source, score)."""
    q = T.cut(with_fields(queries).withColumn("branch", branch()))
    of = lambda *names: q.filter(F.col("branch").isin(*names)).drop("branch")
    seen = articles.drop("title", "abstract_text", "embedding")
    vector = vector_hits(articles.drop("title", "abstract_text"), of("hybrid", "vector").filter(V.valid_vector(F.col("vector"))), candidates)
    bm25 = bm25_hits(seen, index, of("hybrid", "bm25").filter(F.size("terms") > 0), candidates)
    keyed = lambda df: df.join(seen.select("id", G.identity_key().alias("key")), "id")
    fused = G.fuse_rrf(G.merge_candidates(keyed(vector), keyed(bm25))).join(q.select("query_id", "top_k"), "query_id").filter(F.col("fusion_rank") <= F.col("top_k"))
    fused = fused.select("query_id", "id", F.col("fusion_rank").alias("rank"), "retrieval_source", F.col("fusion_score").alias("score"))
    out = [latest_branch(seen, of("latest"), candidates), lookup_branch(articles.drop("embedding"), of("lookup"), as_of), fused]
    return reduce(DataFrame.unionByName, [df.select(*ANSWER) for df in out])


def routed(questions: DataFrame, as_of: str, forced: bool = False, top_k: int = 5) -> DataFrame:
    """(query_id, uses_rag, terms, sort_by, top_k, filter fields) of questions (question_id, question, vector, overrides struct,
    own_top_k): facets of the text, over which the question's own filters go where they are set."""
    kinds = dict(questions.select("overrides.*").dtypes)
    over = questions.withColumn("uses_rag", F.lit(forced) | RT.route(F.col("question")))
    facets = RT.extract_filters(over, "question", as_of, top_k).withColumnsRenamed({"date_from": "publish_date_from", "date_to": "publish_date_to"})
    own = lambda f: F.col(f"overrides.{f}") if f in kinds else F.lit(None)
    found = lambda f: F.col(f) if f in facets.columns else F.lit(None)
    fields = [F.coalesce(own(f).cast(t), found(f).cast(t)).alias(f) for f, t in FIELDS.items()]
    mode = F.col("mode") if "mode" in questions.columns else F.lit("hybrid")
    return facets.select(F.col("question_id").alias("query_id"), "uses_rag", F.col("vector").cast("array<double>").alias("vector"), G.query_terms(F.col("question")).alias("terms"), mode.alias("mode"), "sort_by", F.coalesce("own_top_k", F.lit(top_k)).alias("top_k"), *fields)


def evaluate_retrieval(questions: DataFrame, articles: DataFrame, index: L.StoredIndex, as_of: str, forced: bool = False, top_k: int = 5) -> DataFrame:
    """H2: one row a question (question_id, question, expected, vector, overrides, own_top_k): scores, how many results came from
    which side, and signals. Questions that need no search retrieve nothing and score 0."""
    q = T.cut(routed(questions, as_of, forced, top_k))
    found = T.cut(dispatch(articles, index, q.filter("uses_rag"), as_of))
    ranked = found.select(F.col("query_id").alias("question_id"), "id", "rank")
    golden = questions.select("question_id", "expected").join(q.select(F.col("query_id").alias("question_id"), "top_k"), "question_id")
    scores = EV.score_retrieval(golden, ranked, "top_k")
    source = F.col("retrieval_source")
    named = F.when(source.isin("bm25", "both"), source).otherwise("vector")
    signals = EV.retrieval_signals(found.select(F.col("query_id").alias("question_id"), "id", named.alias("retrieval_source")))
    counts = found.groupBy(F.col("query_id").alias("question_id")).agg(F.count(F.lit(1)).alias("source_count"))
    out = q.select(F.col("query_id").alias("question_id"), "uses_rag", "sort_by", "top_k").join(scores, "question_id", "left").join(signals, "question_id", "left").join(counts, "question_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_vector", "n_bm25", "n_both", "source_count")]
    return out.select("question_id", "uses_rag", "sort_by", "top_k", "hit_at_k", "recall_at_k", "precision_at_k", "mrr", "ndcg_at_k", F.coalesce("duplicate_rate", F.lit(0.0)).alias("duplicate_rate"), *zero, (F.coalesce("source_count", F.lit(0)) == 0).alias("retrieved_context_empty"))
