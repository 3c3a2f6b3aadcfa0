"""Ingest: source records to one article schema, predicates, upserts, sampling (A, B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions import text as T

#: Longest stored value of each column.
LENGTHS = {"source": 50, "external_id": 100, "title": 500, "url": 500, "pdf_url": 500, "primary_category": 100, "doi": 255, "venue": 500, "language": 20, "document_type": 50, "ingestion_run_id": 80}
REQUIRED = ("source", "external_id", "title", "abstract_text")


def is_cs(flag: Column | None = None) -> Column:
    """arXiv needs a cs. category, whatever the flag says; others a flag or the field's name."""
    values = F.transform(F.concat(F.array(F.coalesce("primary_category", F.lit(""))), T.split_list(F.col("categories"))), lambda c: F.lower(F.btrim(c)))
    named = F.exists(values, lambda c: c.isin("computer science", "cs"))
    return F.when(F.lower("source") == "arxiv", F.exists(values, lambda c: c.startswith("cs."))).otherwise(F.coalesce(flag, F.lit(False)) | named if flag is not None else named)


def in_cluster_scope(include_openalex: bool = False, flag: Column | None = None) -> Column:
    """A cs.XX at a list boundary; OpenAlex by flag on request."""
    listed = F.concat_ws(",", F.coalesce("primary_category", F.lit("")), F.coalesce("categories", F.lit("")))
    hit = listed.rlike(r"(^|[,\s])cs\.[A-Za-z]{2}($|[,\s])")
    return hit | ((F.col("source") == "openalex") & F.coalesce(flag, F.lit(False))) if include_openalex and flag is not None else hit


def cs_only() -> Column:
    """B5"""
    return F.coalesce(F.col("primary_category").ilike("cs.%") | F.col("categories").ilike("%cs.%"), F.lit(False))


def cap_lengths(df: DataFrame) -> DataFrame:
    """A long title ends in dots, other columns are cut."""
    out = {}
    for c, n in LENGTHS.items():
        if c in df.columns:
            cut = F.concat(F.substring(c, 1, n - 3), F.lit("...")) if c == "title" else F.substring(c, 1, n)
            out[c] = F.when(F.length(c) > n, cut).otherwise(F.col(c))
    return df.withColumns(out)


#: Fixed value: the incoming key that is not carried on.
PAYLOAD = "ingestion_source_payload"


def build_metadata(df: DataFrame, run_id: str, as_of: str) -> Column:
    """Derived fields as one struct, and what else the incoming map metadata_json (if df has one) held as `carried`. Columns
    that df lacks are null."""
    col = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    kinds = dict(df.dtypes)
    incoming = F.col("metadata_json") if kinds.get("metadata_json", "").startswith("map") else F.lit(None).cast("map<string,string>")
    derived = {
        **{c: col(c) for c in ("source", "external_id", "doi", "url", "pdf_url", "venue")}, "publish_year": F.year("publish_date"), "publish_month": F.month("publish_date"),
        "authors_list": T.split_list(col("authors")), "categories_list": T.split_list(col("categories")), "primary_category": col("primary_category"), "citation_count": col("citation_count", "int"),
        "has_pdf": F.coalesce(col("pdf_url") != "", F.lit(False)), "language": F.coalesce(F.nullif(col("language"), F.lit("")), F.lit("en")), "document_type": F.coalesce(F.nullif(col("document_type"), F.lit("")), F.lit("article")), "ingestion_run_id": F.lit(run_id),
        "source_payload_version": F.coalesce(F.element_at(incoming, "source_payload_version"), F.lit("v1")), "metadata_normalized_at": F.lit(as_of),
    }
    carried = F.map_filter(F.coalesce(incoming, F.expr("cast(map() as map<string,string>)")), lambda k, _: ~k.isin(PAYLOAD, *derived))
    return F.struct(*[c.alias(n) for n, c in derived.items()], carried.alias("carried"))


def to_article_row(df: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """Cleaned strings, defaults, length caps, metadata."""
    strings = {c: T.clean_string(F.col(c)) for c, t in df.dtypes if t == "string"}
    out = df.withColumns(strings).withColumns({"language": F.coalesce("language", F.lit("en")), "document_type": F.lit("article"), "ingestion_run_id": F.lit(run_id)})
    return cap_lengths(out.withColumn("metadata_json", build_metadata(out, run_id, as_of)))


def complete(df: DataFrame) -> DataFrame:
    """B9"""
    return df.filter(" AND ".join(f"nullif({c}, '') IS NOT NULL" for c in REQUIRED))


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of a key wins and keeps the first one's place (_position)."""
    w = Window.partitionBy(key)
    return df.withColumn("_position", F.min(order).over(w)).withColumn("_last", F.max(order).over(w)).filter(F.col(order) == F.col("_last")).drop("_last")


def parse_date(c: Column) -> Column:
    """RFC 2822 to UTC, ISO dates and times with or without Z; else null."""
    t = T.clean_ws(c)
    rfc = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(rfc, r"\s(GMT|UT|UTC)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(t, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))


def first_version_date(versions: Column) -> Column:
    """B13"""
    return F.get(F.filter(F.transform(versions, lambda v: parse_date(v["created"])), lambda d: d.isNotNull()), F.lit(0))


def normalize_doi(c: Column) -> Column:
    """B14"""
    return F.nullif(F.btrim(F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", "")), F.lit(""))


def supported_date(c: Column, floor: str = "2000-01-01") -> Column:
    """B15"""
    return F.coalesce(c >= F.lit(floor).cast("timestamp"), F.lit(True))


def reconstruct_abstract(index: Column) -> Column:
    """A4: word -> positions back to text."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " "), F.lit(""))


def normalize_dump(records: DataFrame) -> DataFrame:
    """A2: dump records (id, title, abstract, categories, versions, update_date, doi, journal_ref) to articles."""
    cats = T.split_space(F.col("categories"))
    ext = T.clean_ws(F.col("id"))
    rows = records.select(
        F.lit("arxiv").alias("source"), ext.alias("external_id"), T.clean_ws(F.col("title")).alias("title"), T.clean_ws(F.col("abstract")).alias("abstract_text"),
        first_version_date(F.col("versions")).alias("publish_date"), parse_date(F.col("update_date")).alias("updated_date"), F.concat(F.lit("https://arxiv.org/abs/"), ext).alias("url"), F.concat(F.lit("https://arxiv.org/pdf/"), ext).alias("pdf_url"),
        F.get(cats, F.lit(0)).alias("primary_category"), F.nullif(F.array_join(cats, ", "), F.lit("")).alias("categories"), T.clean_ws(F.col("doi")).alias("doi"), T.clean_ws(F.col("journal_ref")).alias("venue"), F.exists(cats, lambda c: F.lower(c).startswith("cs.")).alias("is_computer_science"),
    )
    return rows.filter("external_id IS NOT NULL AND title IS NOT NULL")


def write_vectors(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """The new vector where there is one, with whether the row matched."""
    j = articles.join(vectors.select("id", F.col("embedding").alias("_new"), F.lit(True).alias("_hit")), "id", "left")
    return j.withColumns({"embedding": F.coalesce("_new", "embedding"), "matched": F.coalesce("_hit", F.lit(False))}).drop("_new", "_hit")


def upsert_articles(target: DataFrame, batch: DataFrame, key: str = "external_id", overwrite: tuple[str, ...] = ("language",)) -> DataFrame:
    """Per-column COALESCE(new, old), so nulls never erase; language always overwrites."""
    cols = [c for c in target.columns if c != key]
    t, b = target.select(key, F.struct(*cols).alias("_t")), batch.select(key, F.struct(*cols).alias("_b"))
    pick = lambda c: F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}")).otherwise(F.col(f"_t.{c}")) if c in overwrite else F.coalesce(F.col(f"_b.{c}"), F.col(f"_t.{c}"))
    return t.join(b, key, "full").select(key, *[pick(c).alias(c) for c in cols])


def validate_articles(df: DataFrame, required: tuple[str, ...] = REQUIRED, key: str = "external_id") -> DataFrame:
    """(check, value): missing columns, and keys that are not unique."""
    missing = sorted(set(required) - set(df.columns))
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("value")).select(F.lit("duplicate_keys").alias("check"), "value")
    return dup.union(df.sparkSession.range(1).select(F.lit("missing_columns"), F.lit(len(missing)).cast("long")))


def sampling_candidates(df: DataFrame, first: int, last: int) -> DataFrame:
    """B16"""
    y = F.year("publish_date")
    return complete(df).filter(y.between(first, last) & (F.col("doi").isNotNull() | F.col("pdf_url").isNotNull()) & is_cs())


def draw(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))


def sample_per_month(df: DataFrame, k: int, seed: str) -> DataFrame:
    """At most k a month, in the order of a seeded hash."""
    w = Window.partitionBy(F.date_format("publish_date", "yyyy-MM")).orderBy(draw(seed), "id")
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def cap_sample(df: DataFrame, n: int, seed: str) -> DataFrame:
    """B18"""
    return df.orderBy(draw(seed), "id").limit(n)


def month_coverage(df: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """Every month of the years, with its count and whether it is full."""
    months = df.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date '{first}-01-01', date '{last}-12-01', interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    n = df.groupBy(F.date_format("publish_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < k).alias("underfilled"))


def sample_with_fallback(df: DataFrame, n: int, seed: str) -> DataFrame:
    """Embedded rows first, then others."""
    return df.orderBy(F.col("embedding").isNull(), draw(seed), "id").limit(n)
