"""Text hygiene as column functions: no UDF on the main path, so everything stays inside generated code."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_MIN, ABSTRACT_MIN, ABSTRACT_WORDS = 10, 100, 250
SPACE = r"[\s\p{Z}]+"
#: Words of a survey's title.
SURVEY_TERMS = ("survey", "review", "overview", "taxonomy", "systematic literature review", "comprehensive review")
#: Academic phrases that carry no topic.
BOILERPLATE = ("in this paper", "in this work", "we propose", "we present", "we introduce", "we investigate", "we study", "we show", "we demonstrate", "our results show", "experimental results", "extensive experiments", "state of the art", "state-of-the-art", "to the best of our knowledge", "this paper proposes", "this work presents")
#: Category prefixes of each family.
FAMILIES = {"cs": ("cs.",), "math": ("math.",), "stat": ("stat.",), "q-bio": ("q-bio.",), "q-fin": ("q-fin.",), "econ": ("econ.",), "eess": ("eess.",), "physics": ("astro-ph", "cond-mat", "gr-qc", "hep-", "math-ph", "nlin", "nucl-", "physics", "quant-ph")}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, SPACE, " "))


def clean_string(c: Column) -> Column:
    """B1: without NUL and outer blanks; empty is null."""
    return F.nullif(F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def clean_ws(c: Column) -> Column:
    """Without NUL, white space collapsed; empty is null."""
    return F.nullif(collapse(F.replace(c, F.lit("\0"), F.lit(""))), F.lit(""))


def split_list(c: Column) -> Column:
    """B2: comma list as trimmed, non-empty items; null is an empty list."""
    parts = F.transform(F.split(text_or_empty(c), ","), lambda x: F.btrim(x))
    return F.filter(parts, lambda x: x != "")


def split_space(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), SPACE), lambda x: x != "")


def entity_tables() -> tuple[dict[str, str], list[str]]:
    """Names of HTML entities without their ampersand, as Python knows them; those that also count as the beginning of a longer
    name, the longest first."""
    return html5, sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def numbered(n: int) -> str | None:
    """What a number stands for where it is not its own character: 128 to 159 are Windows letters, some numbers nothing."""
    if n == 0:
        return "\ufffd"
    if n == 13:
        return "\r"
    if 0x80 <= n <= 0x9F:
        letter = bytes([n]).decode("cp1252", "ignore")
        return letter or chr(n)
    gone = 1 <= n <= 8 or n == 11 or 14 <= n <= 31 or n == 127 or 0xFDD0 <= n <= 0xFDEF or n & 0xFFFE == 0xFFFE
    return "" if gone else None


#: What may follow an ampersand.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


#: Between the entries of a table that is written as one string; no entity has it.
_BAR = "\x01"


def _map(d: dict) -> Column:
    """A map as two strings, which the planner folds into one literal."""
    list_ = lambda some: F.split(F.lit(_BAR.join(map(str, some))), _BAR)
    keys = list_(d)
    return F.map_from_arrays(keys.cast("array<int>") if all(isinstance(k, int) for k in d) else keys, list_(d.values()))


def _of_number(digits: Column, radix: int) -> Column:
    """The character of a number in text form, of any length."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(short) <= 7, F.conv(short, radix, 10).cast("int"))
    special = {i: x for i in range(160) if (x := numbered(i)) is not None}
    lost = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    return F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(n < 160, F.coalesce(F.element_at(_map(special), n), char)).when(lost, "").when(n == 0xFEFF, "\ufeff").otherwise(char)


def unescape(c: Column) -> Column:
    """All HTML entities as html.unescape() reads them. Texts without an ampersand pass through; each piece that follows one
    is looked up by its whole name, then by the longest name that it begins with."""
    names, openings = entity_tables()
    table = _map(names)

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        rest = F.substring(piece, F.length(name) + 1, F.length(piece))
        digits = F.regexp_replace(name, "[#;xX]", "")
        number = F.when(name.rlike("^#[xX]"), _of_number(digits, 16)).otherwise(_of_number(digits, 10))
        begun = F.regexp_extract(name, f"^({'|'.join(openings)}).", 1)
        # one look at the table, which is large in a plan: the first of the two names that it has
        found = F.get(F.filter(F.transform(F.array(name, begun), lambda k: F.struct(k.alias("k"), F.element_at(table, k).alias("v"))), lambda x: x["v"].isNotNull()), F.lit(0))
        named = F.coalesce(F.transform(F.array(found), lambda x: F.concat(x["v"], F.substring(piece, F.length(x["k"]) + 1, F.length(piece))))[0], F.concat(F.lit("&"), piece))
        return F.when(name == "", F.concat(F.lit("&"), piece)).when(name.startswith("#"), F.concat(number, rest)).otherwise(named)

    pieces = F.split(c, "&")
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), decoded), ""))
    return F.when(c.contains("&"), whole).otherwise(c)


def light_clean(c: Column) -> Column:
    """Entities, white space, dollar runs, commands, braces, white space again; in this order."""
    t = F.regexp_replace(unescape(text_or_empty(c)), SPACE, " ")
    t = F.regexp_replace(t, r"\$+", " ")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+", " ")
    return collapse(F.regexp_replace(t, r"[{}]", " "))


def title_key(c: Column) -> Column:
    """C2"""
    t = F.regexp_replace(F.lower(unescape(text_or_empty(c))), SPACE, " ")
    return collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""))


def remove_boilerplate(c: Column) -> Column:
    """Phrases at word bounds as blanks, one after another."""
    t = F.lower(text_or_empty(c))
    for phrase in BOILERPLATE:
        t = F.regexp_replace(t, rf"\b{phrase}\b", " ")
    return collapse(t)


def words(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), SPACE), lambda x: x != "")


def count_words(c: Column) -> Column:
    """C4"""
    return F.size(words(c))


def truncate_words(c: Column, n: int = ABSTRACT_WORDS) -> Column:
    """C5"""
    return F.array_join(F.slice(words(c), 1, n), " ")


def category_family(c: Column) -> Column:
    """C6"""
    t, out = F.btrim(text_or_empty(c)), F.lit("other")
    for family, prefixes in FAMILIES.items():
        for p in prefixes:
            out = F.when(t.startswith(p), family).otherwise(out)
    return out


def is_survey(title: Column) -> Column:
    """C7"""
    t, out = F.lower(text_or_empty(title)), F.lit(False)
    for term in SURVEY_TERMS:
        out = out | t.contains(term)
    return out


def valid_text(title: Column, abstract: Column) -> Column:
    """C8"""
    return (F.length(light_clean(title)) > TITLE_MIN) & (F.length(light_clean(abstract)) > ABSTRACT_MIN)


def embedding_text(title: Column, abstract: Column, n: int = ABSTRACT_WORDS) -> Column:
    """C9"""
    t = light_clean(title)
    return F.btrim(F.concat(t, F.lit(". "), t, F.lit(". "), truncate_words(light_clean(abstract), n)))


def representation_text(title: Column, abstract: Column, n: int = ABSTRACT_WORDS) -> Column:
    """C10"""
    t = light_clean(title)
    return F.btrim(F.concat(t, F.lit(". "), t, F.lit(". "), remove_boilerplate(truncate_words(light_clean(abstract), n))))
