"""Text preparation, tagged rejects and multi-key de-duplication of paper records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlens.functions import text as T
from litlens.operators.tables import cut

ID_KEYS = ("arxiv_id", "doi", "paper_id")
TOPIC_COLUMNS = ("id", "source", "external_id", "title_clean", "abstract_clean", "embedding_text", "representation_text", "primary_category", "category_family", "is_survey", "lang")


def cleaned_texts(df: DataFrame, title: str, abstract: str) -> DataFrame:
    """The columns of C11 that need expressions over whole texts."""
    out = df.withColumns({"title_clean": T.light_clean(F.col(title)), "abstract_clean": T.light_clean(F.col(abstract))})
    out = out.withColumns({"abstract_word_count": T.count_words(F.col("abstract_clean")), "abstract_truncated": T.truncate_words(F.col("abstract_clean"))})
    return out.withColumn("abstract_representation", T.remove_boilerplate(F.col("abstract_truncated")))


def joined_texts(df: DataFrame) -> DataFrame:
    """The columns of C11 that are put together from those; cheap, so tables are kept without them."""
    twice = lambda c: F.btrim(F.concat(F.col("title_clean"), F.lit(". "), F.col("title_clean"), F.lit(". "), F.col(c)))
    out = df.withColumns({"embedding_text": twice("abstract_truncated"), "representation_text": twice("abstract_representation")})
    return out.withColumns({"embedding_text_len": F.length("embedding_text"), "representation_text_len": F.length("representation_text"), "is_survey": T.is_survey(F.col("title_clean"))})


def prepare_texts(df: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """C11: all derived text columns; each step reads the previous one's column, so nothing is computed twice."""
    return joined_texts(cleaned_texts(df, title, abstract))


def normalize_records(articles: DataFrame) -> DataFrame:
    """Cleaned title and abstract, id columns derived from the external id, lang."""
    return articles.select(
        "id", "source", "external_id", "primary_category", "categories", "doi",
        T.light_clean(F.col("title")).alias("title"), T.light_clean(F.col("abstract_text")).alias("abstract"),
        F.col("external_id").alias("paper_id"), F.when(F.col("source") == "arxiv", F.col("external_id")).alias("arxiv_id"), F.col("language").alias("lang"),
    )


def short_reason(title: str, abstract: str, suffix: str) -> Column:
    """First failing length rule, or null."""
    return F.when(F.length(title) <= T.TITLE_MIN, f"title_too_short_{suffix}").when(F.length(abstract) <= T.ABSTRACT_MIN, f"abstract_too_short_{suffix}")


def split_by_rules(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed with removal_reason)."""
    tagged = df.withColumn("removal_reason", reason)
    return tagged.filter("removal_reason IS NULL").drop("removal_reason"), tagged.filter("removal_reason IS NOT NULL")


def keys_of(records: DataFrame) -> DataFrame:
    """A table (id, id keys, title_norm, removal_reason) of normalized records: all that the rules and de-duplication need. Texts
    are read for it once, however many passes follow."""
    return cut(records.select("id", *ID_KEYS, T.title_key(F.col("title")).alias("title_norm"), short_reason("title", "abstract", "or_empty").alias("removal_reason")))


def _first_of_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """df with _later: whether an earlier row has the same non-empty key. First rows are summed up within tasks and joined back,
    so a key of very many rows is no single task's; rows without a key are not joined."""
    keyed = df.withColumn("_key", F.nullif(F.btrim(key.cast("string")), F.lit("")))
    has = keyed.filter("_key IS NOT NULL")
    first = has.groupBy("_key").agg(F.min(order).alias("_first"))
    joined = has.join(first, "_key").withColumn("_later", F.col(order) > F.col("_first")).drop("_key", "_first")
    return joined.unionByName(keyed.filter("_key IS NULL").drop("_key").withColumn("_later", F.lit(False)))


def dedupe_ids(df: DataFrame, keys: tuple[str, ...] = ID_KEYS, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """C14: one pass a key over the survivors of the previous ones; the first row of a key wins. Each pass reads the one before from
    a table, and df should be a table of keys (keys_of)."""
    kept, dropped = df, []
    for key in keys:
        marked = cut(_first_of_key(kept, F.col(key), order))
        dropped.append(marked.filter("_later").drop("_later").withColumn("duplicate_reason", F.lit(f"duplicate_{key}")))
        kept = marked.filter("NOT _later").drop("_later")
    out = dropped[0]
    for d in dropped[1:]:
        out = out.unionByName(d)
    return kept, out


def dedupe_titles(df: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """By df's title_norm, or by that of its titles."""
    df = df if "title_norm" in df.columns else df.withColumn("title_norm", T.title_key(F.col("title")))
    marked = _first_of_key(df, F.col("title_norm"), order)
    return marked.filter("NOT _later").drop("_later"), marked.filter("_later").drop("_later").withColumn("duplicate_reason", F.lit("duplicate_normalized_title"))


def filter_language(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeps English once any row has a language; a missing one then counts as English."""
    lang = F.lower(F.btrim(F.coalesce("lang", F.lit("en"))))
    any_lang = df.agg(F.coalesce(F.bool_or(F.length(F.btrim(F.coalesce("lang", F.lit("")))) > 0), F.lit(False)).alias("_filter"))
    tagged = df.crossJoin(F.broadcast(any_lang)).withColumn("_l", F.when(lang == "", "unknown").otherwise(lang))  # one row
    kept = tagged.filter("NOT _filter OR _l = 'en'").withColumn("lang", F.when(F.col("_filter"), F.col("_l")).otherwise(F.col("lang")))
    gone = tagged.filter("_filter AND _l <> 'en'").withColumn("removal_reason", F.lit("non_english_or_unknown_language"))
    return kept.drop("_filter", "_l"), gone.withColumn("lang", F.col("_l")).drop("_filter", "_l")


@dataclass
class Hygiene:
    clean: DataFrame
    removed: DataFrame
    duplicates: DataFrame
    metrics: DataFrame


def hygiene_metrics(before: DataFrame, after: DataFrame, duplicates: DataFrame) -> DataFrame:
    """C17: (metric, value); one aggregation over each table."""
    n = lambda c: F.count_if(c).cast("double")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    first = before.agg(F.count(F.lit(1)).cast("double").alias("initial_rows"), n(F.length("title") == 0).alias("empty_title_count"), n(F.length("abstract") == 0).alias("empty_abstract_count"), n(F.length("title") <= T.TITLE_MIN).alias("short_title_count_len_le_10"), n(F.length("abstract") <= T.ABSTRACT_MIN).alias("short_abstract_count_len_le_100"), F.coalesce(F.max(F.when(F.length(F.btrim(F.coalesce("lang", F.lit("")))) > 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("language_filter_applied"))
    last = after.agg(F.count(F.lit(1)).cast("double").alias("final_rows"), n(F.length("title_clean") == 0).alias("final_empty_title_count"), n(F.length("abstract_clean") == 0).alias("final_empty_abstract_count"), mean(F.length("title_clean")).alias("avg_title_length"), mean(F.length("abstract_clean")).alias("avg_abstract_length"), mean(F.col("abstract_word_count")).alias("avg_abstract_word_count"), n(F.col("is_survey")).alias("survey_count"))
    wide = first.crossJoin(last).crossJoin(duplicates.agg(F.count(F.lit(1)).cast("double").alias("duplicate_total")))  # one row each
    wide = wide.withColumn("removed_total", F.col("initial_rows") - F.col("final_rows"))
    return wide.unpivot([], wide.columns, "metric", "value")


def clean_papers(articles: DataFrame) -> Hygiene:
    """The whole path. Texts are cleaned once, into a table; rules and de-duplication work on keys and lengths, and what they
    say of each id is joined back to the texts once."""
    rows = cut(normalize_records(articles))
    light = keys_of(rows)
    kept, by_id = dedupe_ids(light.filter("removal_reason IS NULL"))
    later = dedupe_titles(kept)[1].select("id", "duplicate_reason")
    dups = by_id.select("id", "duplicate_reason").unionByName(later)
    # the narrow side is hashed, so no texts are sorted
    tags = light.select("id", "title_norm", "removal_reason").join(dups, "id", "left")
    told = cut(rows.join(tags.hint("shuffle_hash"), "id"))
    kept = joined_texts(cut(cleaned_texts(told.filter("removal_reason IS NULL AND duplicate_reason IS NULL").drop("removal_reason", "duplicate_reason"), "title", "abstract")))
    base = rows.columns
    kept, removed2 = split_by_rules(kept, short_reason("title_clean", "abstract_clean", "after_cleaning"))
    kept, removed3 = filter_language(kept)
    clean = kept.withColumn("category_family", T.category_family(F.col("primary_category")))
    pick = lambda df, tag: df.select(*base, tag)
    gone = pick(told.filter("removal_reason IS NOT NULL"), "removal_reason").unionByName(pick(removed2, "removal_reason")).unionByName(pick(removed3, "removal_reason"))
    copies = pick(told.filter("duplicate_reason IS NOT NULL"), "duplicate_reason")
    return Hygiene(clean, gone, copies, hygiene_metrics(rows, clean, copies))


def topic_input(df: DataFrame) -> DataFrame:
    """C19"""
    return df.select(*[c for c in TOPIC_COLUMNS if c in df.columns])
