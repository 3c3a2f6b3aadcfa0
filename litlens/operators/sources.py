"""Source payloads of two paper services to the article schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlens.operators.ingest import normalize_doi, parse_date, reconstruct_abstract

#: The field's name and its concept id.
CS_NAME, CS_CONCEPT = "computer science", "C41008148"


def _filled(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def joined_names(names: Column) -> Column:
    """Non-empty distinct names, in order, joined by commas; null without any."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != ""))), ", "), F.lit(""))


def is_cs_openalex() -> Column:
    """A5: a concept by id or name, or a topic by name, subfield, field or domain."""
    named = lambda c: F.coalesce(F.lower(c) == CS_NAME, F.lit(False))
    concept = F.exists("concepts", lambda c: (F.coalesce(F.element_at(F.split(c["id"], "/"), -1), F.lit("")) == CS_CONCEPT) | named(c["display_name"]))
    topic = F.exists("topics", lambda t: named(t["display_name"]) | named(t["subfield"]["display_name"]) | named(t["field"]["display_name"]) | named(t["domain"]["display_name"]))
    return F.coalesce(concept, F.lit(False)) | F.coalesce(topic, F.lit(False))


def normalize_openalex(df: DataFrame) -> DataFrame:
    """A3"""
    names = F.concat(F.array(F.col("primary_topic.display_name")), F.transform("topics", lambda t: t["display_name"]), F.transform("concepts", lambda c: c["display_name"]))
    rest = F.concat(F.transform("topics", lambda t: t["display_name"]), F.transform("concepts", lambda c: c["display_name"]))
    listed = F.when(F.array_contains(F.filter(rest, lambda x: x.isNotNull()), F.coalesce("primary_topic.display_name", F.lit(""))), rest).otherwise(names)
    return df.select(
        F.lit("openalex").alias("source"), F.element_at(F.split("id", "/"), -1).alias("external_id"), F.coalesce(_filled("title", "display_name"), F.lit("Untitled")).alias("title"),
        reconstruct_abstract(F.col("abstract_inverted_index")).alias("abstract_text"), parse_date(F.col("publication_date")).alias("publish_date"),
        F.array_join(F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull() & (x != "")), ", ").alias("authors"),
        _filled("best_oa_location.pdf_url", "primary_location.pdf_url", "open_access.oa_url").alias("pdf_url"), _filled("primary_location.landing_page_url", "best_oa_location.landing_page_url", "doi", "id").alias("url"),
        F.col("primary_topic.display_name").alias("primary_category"), joined_names(listed).alias("categories"), normalize_doi(F.col("doi")).alias("doi"), F.col("cited_by_count").alias("citation_count"),
        _filled("primary_location.source.display_name", "best_oa_location.source.display_name").alias("venue"), is_cs_openalex().alias("is_computer_science"),
    )


#: The entries of an Atom feed, as the XML reader gives them.
ATOM = """id string, title string, summary string, published string, updated string, author array<struct<name: string>>, link array<struct<_href: string, _title: string>>,
category array<struct<_term: string>>, `arxiv:primary_category` struct<_term: string>, `arxiv:doi` string, `arxiv:journal_ref` string"""


def normalize_atom(df: DataFrame) -> DataFrame:
    """Entries read with the schema ATOM and rowTag entry."""
    text = lambda c: F.nullif(F.btrim(F.col(f"`{c}`"), F.lit(" \t\r\n")), F.lit(""))
    terms = F.filter(F.transform("category", lambda c: c["_term"]), lambda t: t.isNotNull() & (t != ""))
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    names = F.filter(F.transform("author", lambda a: F.btrim(a["name"])), lambda x: x.isNotNull() & (x != ""))
    return df.select(
        F.lit("arxiv").alias("source"), F.coalesce(F.element_at(F.split(text("id"), "/"), -1), F.lit("")).alias("external_id"), F.coalesce(text("title"), F.lit("Untitled")).alias("title"), text("summary").alias("abstract_text"),
        F.try_to_timestamp(text("published")).alias("publish_date"), F.try_to_timestamp(text("updated")).alias("updated_date"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("authors"), text("id").alias("url"), pdf.alias("pdf_url"),
        F.coalesce(F.col("`arxiv:primary_category`._term"), F.get(terms, F.lit(0))).alias("primary_category"), F.nullif(F.array_join(terms, ", "), F.lit("")).alias("categories"), text("arxiv:doi").alias("doi"), F.lit(None).cast("int").alias("citation_count"),
        text("arxiv:journal_ref").alias("venue"), F.coalesce(F.exists(terms, lambda t: F.lower(t).startswith("cs.")), F.lit(False)).alias("is_computer_science"),
    )


def normalize_s2(df: DataFrame) -> DataFrame:
    """A6"""
    names = F.concat(F.transform("s2FieldsOfStudy", lambda f: f["category"]), F.col("fieldsOfStudy"))
    return df.select(
        F.lit("semanticscholar").alias("source"), F.col("paperId").alias("external_id"), F.coalesce(_filled("title"), F.lit("Untitled")).alias("title"), F.col("abstract").alias("abstract_text"), parse_date(F.col("publicationDate")).alias("publish_date"),
        F.array_join(F.filter(F.transform("authors", lambda a: a["name"]), lambda x: x.isNotNull() & (x != "")), ", ").alias("authors"), F.col("openAccessPdf.url").alias("pdf_url"), F.get(F.transform("s2FieldsOfStudy", lambda f: f["category"]), F.lit(0)).alias("primary_category"),
        joined_names(names).alias("categories"), F.col("externalIds.DOI").alias("doi"), F.col("citationCount").alias("citation_count"), _filled("publicationVenue.name", "venue", "journal.name").alias("venue"), F.exists(names, lambda x: F.coalesce(F.lower(x) == CS_NAME, F.lit(False))).alias("is_computer_science"),
    )


