"""A stored lexical index: postings by term in blocks of neighbouring ids with their largest scores, and a fingerprint of the
articles it was built from (G6, G7, G9).

Layout, below one folder: blocks/bucket=b (term, page, top, hits), sorted by term, of which a search reads the buckets and row
groups of its terms; terms/bucket=b (term, df); meta (one row: fingerprint, n, avg_length, k1, b, title_weight). A page is
PAGE consecutive ids, so the blocks of a query's terms on one page add up to a bound for every article on it. A search scores
the pages of the highest bounds first; the n-th best score that it finds so rules out all pages with a lower bound.

A build is written aside and takes the old one's place when it is whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.operators import search as G
from litlens.operators import tables as T

BUCKETS, PAGE = 64, 1024
#: Pages a task of a build gets, on average; neighbouring pages of a bucket that go to one file.
TASK_PAGES, RUN = 4, 256
#: Up to so many different terms of a table of queries are written into the scan's predicate.
MOST_TERMS = 4096
#: Pages of a query that are scored before the others are ruled out.
FIRST_PAGES = 4
#: Hits that a task of a search adds up, on average.
TASK_HITS = 250_000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _fingerprint(articles: DataFrame) -> tuple[str, int]:
    row = articles.agg(F.count(F.lit(1)).alias("a"), F.count("embedding").alias("e"), F.max("id").alias("m")).first()
    return f"articles={row['a']} embedded={row['e']} max_id={row['m']}", row["a"]


def fingerprint(articles: DataFrame) -> str:
    """Number of articles, of embedded ones, and the largest id."""
    return _fingerprint(articles)[0]


@dataclass(frozen=True)
class StoredIndex:
    blocks: DataFrame  # bucket, term, page, top, hits
    terms: DataFrame  # bucket, term, df
    n: int
    avg_length: float
    fingerprint: str | None


def _part(f: Column, length: Column, avg_length) -> Column:
    return f * (G.K1 + 1) / (f + G.K1 * (1 - G.B + G.B * length / avg_length))


#: Fields as arrays of their own take a third of an array of structs. A block may come in parts; its words and df add up.
_PAGED = "page long, term string, words long, place array<short>, tf_title array<int>, tf_abstract array<int>, length array<int>"


def _page_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (as _PAGED) of rows (page, id, title words t, abstract words a) in the order of their ids."""
    for b in batches:
        title, abstract = b.column("t").flatten(), b.column("a").flatten()
        coded = pa.concat_arrays([title, abstract]).dictionary_encode()
        if not len(coded):
            continue
        page, ids = (b.column(c).to_numpy() for c in ("page", "id"))
        sizes = [pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "a")]
        length = sizes[0] + sizes[1]
        # equal rows of one id count as one article
        new = np.r_[True, (ids[1:] != ids[:-1]) | (length[1:] != length[:-1])]
        doc, page, ids, length = np.cumsum(new) - 1, page[new], ids[new], length[new]
        n = len(ids)
        key = coded.indices.to_numpy().astype(np.int64) * n + np.concatenate([np.repeat(doc, k) for k in sizes])
        key = np.sort(key * 2 + (np.arange(len(key)) < len(title)))
        first = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1])
        tf, tf_title = np.diff(np.r_[first, len(key)]), np.add.reduceat(key & 1, first)
        term, at = np.divmod(key[first] >> 1, n)
        start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (page[at[1:]] != page[at[:-1]])])
        ends = np.r_[start, len(first)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(k))) for v, k in ((ids[at] - page[at] * PAGE, np.int16), (tf_title, np.int32), (tf - tf_title, np.int32), (length[at], np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(page[at[start]]), coded.dictionary.take(pa.array(term[start])), pa.array(np.add.reduceat(tf, start)), *lists], ["page", "term", "words", "place", "tf_title", "tf_abstract", "length"])


def build(articles: DataFrame, folder: str) -> StoredIndex:
    """The index of articles (id, title, abstract_text, embedding) at folder."""
    spark = articles.sparkSession
    mark, count = _fingerprint(articles)
    parts = max(T.partitions(spark), math.ceil(count / (TASK_PAGES * PAGE)))
    texts = articles.filter("title IS NOT NULL AND abstract_text IS NOT NULL").select("id", F.floor(F.col("id") / PAGE).alias("page"), "title", "abstract_text")
    T.ship(spark)
    # a page's articles lie in one task, so words are counted and blocks made without another shuffle
    rows = texts.repartition(parts, "page").sortWithinPartitions("page", "id").select("page", "id", G.words_of(F.col("title")).alias("t"), G.words_of(F.col("abstract_text")).alias("a"))
    paged = T.cut(rows.mapInArrow(_page_blocks, _PAGED))
    n, words = texts.count(), paged.agg(F.sum("words")).first()[0] or 0
    average = words / n if words else 1.0
    made = f"{folder}.new-{uuid.uuid4().hex}"
    order = ["bucket", "term", "page"]
    # runs of pages split frequent terms; each bucket is a few files
    dealt = paged.withColumn("bucket", bucket(F.col("term"))).repartition(parts, F.col("bucket"), F.floor(F.col("page") / RUN)).sortWithinPartitions(*order)
    at = lambda c, i: F.get(c, i).cast("long").alias(c)
    hits = F.transform("place", lambda p, i: F.struct((F.col("page") * PAGE + p).alias("id"), at("tf_title", i), at("tf_abstract", i), at("length", i)))
    part = lambda h: _part(G.TITLE_WEIGHT * h["tf_title"] + h["tf_abstract"], h["length"], F.lit(float(average)))
    blocks = dealt.select("term", "page", F.size("place").cast("long").alias("df"), hits.alias("hits"), "bucket")
    blocks.select("term", "page", F.array_max(F.transform("hits", part)).alias("top"), "df", "hits", "bucket").write.partitionBy("bucket").parquet(f"{made}/blocks")
    T.discard(paged)
    back = spark.read.schema(_BLOCKS).parquet(f"{made}/blocks")
    back.groupBy("bucket", "term").agg(F.sum("df").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{made}/terms")
    # meta comes last: without it there is no index
    spark.createDataFrame([(mark, n, float(average), G.K1, G.B, G.TITLE_WEIGHT)], "fingerprint string, n long, avg_length double, k1 double, b double, title_weight double").write.parquet(f"{made}/meta")
    T.publish(spark, made, folder)
    return read(spark, folder)


_BLOCKS = "term string, page bigint, top double, df bigint, hits array<struct<id: bigint, tf_title: bigint, tf_abstract: bigint, length: bigint>>, bucket int"


def read(spark: SparkSession, folder: str) -> StoredIndex:
    meta = spark.read.parquet(f"{folder}/meta").first()
    if (meta["k1"], meta["b"], meta["title_weight"]) != (G.K1, G.B, G.TITLE_WEIGHT):
        raise ValueError("the index was built with other weights, its bounds do not hold")
    return StoredIndex(spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks"), spark.read.schema("term string, df bigint, bucket int").parquet(f"{folder}/terms"), meta["n"], meta["avg_length"], meta["fingerprint"])


def status(articles: DataFrame, folder: str) -> str:
    """Missing without an index, unknown if its fingerprint can't be read, stale if it is another one, else ok."""
    spark = articles.sparkSession
    if not T.exists(spark, folder):
        return "missing"
    try:
        stored = read(spark, folder).fingerprint
    except Exception:  # whatever is there, it can't be read
        return "unknown"
    return "unknown" if stored is None else "ok" if stored == fingerprint(articles) else "stale"


def opened(articles: DataFrame, folder: str) -> StoredIndex:
    """The stored index, built anew unless it is the articles' own."""
    return read(articles.sparkSession, folder) if status(articles, folder) == "ok" else build(articles, folder)


def postings(index: StoredIndex) -> DataFrame:
    """(term, id, tf_title, tf_abstract)"""
    return index.blocks.select("term", F.explode("hits").alias("h")).select("term", "h.id", "h.tf_title", "h.tf_abstract")


def search(index: StoredIndex, queries: DataFrame, n: int, keep: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, terms array): OR of terms, title hits weigh three. keep narrows rows
    (query_id, id, score) before they are ranked."""
    wanted = T.cut(queries.select("query_id", F.explode("terms").alias("term")).withColumn("bucket", bucket(F.col("term"))))
    asked = wanted.select("bucket", "term").distinct().limit(MOST_TERMS + 1).collect()
    blocks, terms = index.blocks, index.terms
    if len(asked) <= MOST_TERMS:
        here = F.col("bucket").isin(sorted({r["bucket"] for r in asked})) & F.col("term").isin(sorted({r["term"] for r in asked}))
        blocks, terms = blocks.filter(here), terms.filter(here)
    idf = F.greatest(F.lit(1e-6), F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # small tables of known size: the blocks meet them where they are read, so no hits are shuffled before they are added up
    wanted = T.cut(wanted.join(terms, ["bucket", "term"]).select("query_id", "bucket", "term", idf.alias("idf")))
    bounds = T.cut(blocks.select("bucket", "term", "page", "top").join(wanted, ["bucket", "term"]).groupBy("query_id", "page").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")))

    # the blocks of a page of a query meet in one task, and there are as many tasks as their hits need
    most = wanted.join(terms, ["bucket", "term"]).agg(F.sum("df")).first()[0] or 0
    tasks = max(T.partitions(wanted.sparkSession), math.ceil(most / TASK_HITS))

    def scored(pages: DataFrame, tasks: int) -> DataFrame:
        some = blocks.select("bucket", "term", "page", "hits").join(wanted, ["bucket", "term"]).join(pages, ["query_id", "page"], "left_semi")
        hits = some.select("query_id", "page", "idf", "hits").repartition(tasks, "query_id", "page").select("query_id", "page", "idf", F.explode("hits").alias("h"))
        part = _part(G.TITLE_WEIGHT * F.col("h.tf_title") + F.col("h.tf_abstract"), F.col("h.length"), F.lit(index.avg_length))
        return keep(hits.groupBy("query_id", "page", F.col("h.id").alias("id")).agg(F.sum(F.col("idf") * part).alias("score")).select("query_id", "id", "score"))

    order = [F.desc(F.round("score", 9)), F.col("id")]
    first = G.top(bounds, [F.desc("bound"), F.col("page")], FIRST_PAGES, "_n")
    least = G.top(scored(T.cut(first.select("query_id", "page")), T.partitions(wanted.sparkSession)), order, n).filter(F.col("rank") == n).select("query_id", F.col("score").alias("least"))
    # sums of parts may differ in their last digits
    may = T.cut(bounds.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("query_id", "page"))
    return G.top(scored(may, tasks), order, n)


def search_filtered(index: StoredIndex, queries: DataFrame, articles: DataFrame, f: G.Filters, n: int) -> DataFrame:
    """G9 with filters: the index knows no links to files and no citation counts, so only the other filters narrow it; 4 n hits are
    ranked, then all filters are applied to the article rows. Ranks are those of before."""
    early = articles.filter(G.predicate(replace(f, has_pdf=None, min_citation_count=None))).select("id")
    hits = search(index, queries, 4 * n, lambda h: h.join(early, "id", "left_semi").select("query_id", "id", "score"))
    kept = hits.join(articles.filter(G.predicate(f)).select("id"), "id", "left_semi")
    return G.top(kept, [F.col("rank")], n, "_place").drop("_place")
