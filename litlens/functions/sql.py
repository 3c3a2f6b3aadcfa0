"""Operators as SQL functions of a session."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_TERM = re.compile(r"[^\W]+")


@udtf(returnType="term: string, position: int", useArrow=True)
class TextTerms:
    """The terms of a text with their places, from 1."""

    def eval(self, text: str):
        for i, m in enumerate(_TERM.finditer((text or "").lower()), 1):
            yield m[0], i


#: Names and bodies of the scalar functions: plain SQL, so they are inlined.
FUNCTIONS = {
    "litlens_clean_ws": ("x STRING", "STRING", r"btrim(regexp_replace(x, '\\s+', ' '))"),
    "litlens_count_terms": ("x STRING", "INT", r"size(regexp_extract_all(lower(coalesce(x, '')), '[\\p{L}\\p{N}_]+', 0))"),
    "litlens_count_words": ("x STRING", "INT", r"size(filter(split(coalesce(x, ''), '[\\s\\p{Z}]+'), w -> w <> ''))"),
    "litlens_truncate_words": ("x STRING, n INT", "STRING", r"array_join(slice(filter(split(coalesce(x, ''), '[\\s\\p{Z}]+'), w -> w <> ''), 1, n), ' ')"),
    "litlens_light_clean": ("x STRING", "STRING", r"btrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '[$]+', ' '), '[\\\\][a-zA-Z]+', ' '), '[{}]', ' '), '[\\s\\p{Z}]+', ' '))"),
    "litlens_title_key": ("x STRING", "STRING", r"btrim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(x, '')), '[\\s\\p{Z}]+', ' '), '[^\\p{L}\\p{N}_ ]', ''), ' +', ' '))"),
    "litlens_normalize_doi": ("x STRING", "STRING", r"nullif(regexp_replace(btrim(x), '^(https?://)?(dx\\.)?doi\\.org/', ''), '')"),
    "litlens_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN a IS NULL OR b IS NULL THEN 0D ELSE coalesce(try_divide(aggregate(zip_with(a, b, (u, v) -> u * v), 0D, (s, z) -> s + z), sqrt(aggregate(a, 0D, (s, z) -> s + z * z)) * sqrt(aggregate(b, 0D, (s, z) -> s + z * z))), 0D) END"),
    "litlens_keyword_component": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 0 THEN least(0.65D, ln(1 + x) / 5) ELSE 0D END"),
    "litlens_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (u, v) -> u * v), 0D, (s, z) -> s + z)"),
}


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_terms", TextTerms)
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
