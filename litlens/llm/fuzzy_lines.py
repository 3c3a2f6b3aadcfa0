"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, one line kept per component.

DataFrame functions only. A line is compared in lower case without outer blanks; blank lines always stay.

* Equal lines form a class (two hashes), summed up before any shuffle, so a line that a third of all documents share is one
  row per task. Classes lie in a table dealt by their hashes, so their signatures need no further shuffle.
* A line's set holds all its overlapping shingles of `GRAM` characters (UTF-16 units). Its signature comes from the same set, by
  one-permutation MinHash: the hash space is cut into BANDS x ROWS bins, and each bin's smallest hash is a minimum of its own,
  independent of the other bins'. Empty bins agree with empty bins only; a band whose bins are all empty is left out.
* Two lines meet in a bucket when a band's minima agree. Simulated sets of 1 to 350 shingles at Jaccard 0.8 meet with
  probability 0.997 to 1, one of 4,000 shingles with 0.994. Eight characters keep unlike lines out of each other's buckets: with
  five, 1.4 of 2.0 million distinct lines of 0.5 GB shared a bucket with another one.
* In each bucket every class is compared with the first one; then those in other components with `HEADS` further ones, in as
  many hash orders; then what still lies in different components, every pair of it, in parts of about `CROWD` lines. So no link
  between components that meets in a bucket is missed, and groups of near copies never expand into all pairs.
* Sizes of the sets, and the parities of their shingles in 1,024 hash bins, bound from below how many shingles two lines do not
  share, and rule pairs out without loss. Other pairs are links when the Jaccard similarity of their sets reaches `threshold`,
  counted on the whole lines.
* Of each component the first line by (doc_id, position) stays; all others go.

Defined cases: null text stays null, empty text stays empty; a document that loses all lines keeps its row with an empty
text; documents with a null doc_id keep all lines and count for no other; rows of one doc_id are one document, so equal lines
at one position of them stay or go together; an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.common import bucketed, checkpoint, components, discard, left_join_marked, read_table, semi_by_bitmap

GRAM, BANDS, ROWS = 8, 10, 4
#: Bits of a band's hash that are shuffled; a chance meeting costs one comparison.
BAND_BITS = 42
#: Lines that one document may have.
PLACES = 1 << 31
#: Lines of a bucket that one task compares with the others.
CROWD = 1024
#: Further lines of a mixed bucket that others are compared with; 64-bit words of parities.
HEADS, WORDS = 6, 16


def normal(line: Column) -> Column:
    return F.trim(F.lower(line))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, k1, k2) of the lines that are not blank."""
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", normal(F.col("line"))).filter("line <> ''")
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.hash("line", F.length("line"))})


def classes_of(docs: DataFrame) -> DataFrame:
    """(k1, k2, first, n, line) of every class of equal lines: first is its first place as one number, n its lines."""
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(12,0)") + F.col("pos")
    return bucketed(lines_of(docs).groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line")), "k1", "k2")


def bands_of(classes: DataFrame) -> DataFrame:
    """(k1, band): the buckets of each class. All steps are keyed by the class, so rows stay where they are."""
    units = F.expr(f"sequence(0, greatest(length(units) div 2 - {GRAM}, 0))")
    grams = classes.select("k1", "k2", F.encode("line", "UTF-16BE").alias("units")).select("k1", "k2", "units", F.explode(units).alias("at"))
    grams = grams.select("k1", "k2", F.expr(f"xxhash64(substring(units, 2 * at + 1, {2 * GRAM}))").alias("h"))
    bins = grams.withColumn("bin", F.pmod("h", F.lit(BANDS * ROWS)).cast("int")).groupBy("k1", "k2", "bin").agg(F.min("h").alias("low"))
    rows = [F.min(F.when(F.floor(F.col("bin") / BANDS) == r, F.col("low"))) for r in range(ROWS)]
    bands = bins.groupBy("k1", "k2", (F.col("bin") % BANDS).alias("b")).agg(*[c.alias(f"r{i}") for i, c in enumerate(rows)])
    missing = sum((F.when(F.col(f"r{i}").isNull(), 1 << i).otherwise(0) for i in range(1, ROWS)), F.when(F.col("r0").isNull(), 1).otherwise(0))
    return bands.select("k1", F.shiftright(F.xxhash64("b", missing, *[f"r{i}" for i in range(ROWS)]), 64 - BAND_BITS).alias("band"))


def overlapping(line: Column) -> Column:
    """Overlapping shingles of a line, repeated ones too; a shorter line is one."""
    return F.when(F.length(line) < GRAM, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def sets_of(lines: DataFrame) -> DataFrame:
    """(k1, n, p0, p1, ...) of lines (k1, line): number of distinct shingles, and their parities in 64 bins a column."""
    grams = lines.select("k1", F.explode(F.array_distinct(overlapping(F.col("line")))).alias("gram")).select("k1", F.xxhash64("gram").alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = grams.groupBy("k1", F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("w")).agg(F.bit_xor(bit).alias("p"), F.count(F.lit(1)).alias("n"))
    word = lambda i: F.coalesce(F.max(F.when(F.col("w") == i, F.col("p"))), F.lit(0).cast("long")).alias(f"p{i}")
    return words.groupBy("k1").agg(F.sum("n").alias("n"), *[word(i) for i in range(WORDS)])


def may_link(threshold: float) -> Column:
    """Whether sizes and parities of lines a and b leave room for a link."""
    apart = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(1, WORDS)), F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    return (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (apart * (1 + threshold) <= (1 - threshold) * (F.col("n_a") + F.col("n_b")) + 1e-9)


def end(rows: DataFrame, x: str) -> DataFrame:
    """rows with k1 named x and `_x` behind the other columns' names."""
    return rows.select(*[F.col(c).alias(x if c == "k1" else f"{c}_{x}") for c in rows.columns])


def links_of(classes: DataFrame, threshold: float) -> DataFrame:
    """Linked pairs (a, b) of class hashes."""
    spread = checkpoint(bands_of(classes))
    # buckets of several classes: few, and known before any of their members move
    heads = spread.groupBy("band").agg(F.min("k1").alias("head"), F.max("k1").alias("last")).filter("head <> last")
    heads = checkpoint(heads.select("band", "head"))
    members = checkpoint(semi_by_bitmap(spread, "band", heads, bits=1 << 25).join(heads, "band").select("band", "head", "k1").distinct())
    discard(spread, heads)
    ends = members.select("k1").distinct()
    texts = semi_by_bitmap(classes.select("k1", "line"), "k1", ends, bits=1 << 25).join(ends, "k1", "left_semi").groupBy("k1").agg(F.min("line").alias("line"))
    texts = bucketed(texts, "k1")  # the sets, by line, need no shuffle
    sets = checkpoint(sets_of(texts))

    def possible(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(end(sets, "a"), "a").join(end(sets, "b"), "b").filter(may_link(threshold)).select("a", "b")

    def still_apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """(band, k1, component, held) of the buckets that hold several components."""
        apart = rows.join(groups, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
        mixed = apart.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("held")).filter("lo <> hi").select("band", "held")
        return checkpoint(apart.join(mixed, "band"))

    def groups_of(links: DataFrame) -> DataFrame:
        return components(links).select(F.col("node").alias("k1"), "component")

    tried = checkpoint(possible(members.filter("head <> k1").select(F.col("head").alias("a"), F.col("k1").alias("b"))))
    links = verify(tried, texts, sets, threshold)
    apart = still_apart(members.select("band", "k1"), groups_of(links)).filter("held > 2")
    # further heads for what lies in another component than they: a few rows a bucket, whatever it holds
    order = lambda r: F.struct(F.xxhash64("k1", F.lit(r)).alias("h"), F.col("k1").alias("head"), F.col("component").alias("c_head"))
    heads = apart.groupBy("band").agg(F.array(*[F.min(order(r)) for r in range(HEADS)]).alias("heads")).select("band", F.explode("heads").alias("x")).select("band", "x.head", "x.c_head").distinct()
    more = apart.join(heads, "band").filter("component <> c_head").select(F.least("k1", "head").alias("a"), F.greatest("k1", "head").alias("b"))
    more = checkpoint(possible(more).join(tried, ["a", "b"], "left_anti"))
    links = checkpoint(links.union(verify(more, texts, sets, threshold)))
    # what still lies in different components of a bucket, every pair of it that sizes and parities leave
    rest = still_apart(apart.select("band", "k1"), groups_of(links)).join(sets, "k1").withColumn("parts", F.ceil(F.col("held") / CROWD))
    rest = checkpoint(rest.drop("held"))
    # a large bucket is dealt to several tasks: a line is in one part, and meets all parts
    left = end(rest, "a").withColumnsRenamed({"band_a": "band"}).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts_a")))
    right = end(rest, "b").withColumnsRenamed({"band_b": "band"}).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_b") - 1)))
    last = left.join(right, ["band", "part"]).filter(F.expr("a < b and component_a <> component_b") & may_link(threshold)).select("a", "b").distinct()
    last = checkpoint(last.join(tried.union(more), ["a", "b"], "left_anti"))
    if not last.isEmpty():
        links = checkpoint(links.union(verify(last, texts, sets, threshold)))
    discard(members, texts, sets, tried, apart, more, rest, last)
    return links


def verify(pairs: DataFrame, texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs that are links, counted on the whole lines."""
    known = texts.join(sets.select("k1", "n"), "k1")
    both = pairs.join(end(known, "a"), "a").join(end(known, "b"), "b")
    union = F.size(F.array_union(overlapping(F.col("line_a")), overlapping(F.col("line_b"))))
    return checkpoint(both.filter(F.col("n_a") + F.col("n_b") >= (1 + threshold) * union - 1e-9).select("a", "b"))


def doomed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, gone array<struct<pos, k1>>): the lines that go."""
    classes = classes_of(docs)
    links = links_of(classes, threshold)
    groups = components(links)
    grouped = classes.drop("line").join(groups.select(F.col("node").alias("k1"), "component"), "k1", "left").filter("n > 1 or component is not null")
    grouped = checkpoint(grouped.withColumn("component", F.coalesce("component", "k1")))
    keeper = grouped.groupBy("component").agg(F.min("first").alias("keep"))
    kept = grouped.join(keeper, "component")
    doc = F.floor(F.col("keep") / PLACES).cast("long")
    kept = checkpoint(kept.select("k1", "k2", doc.alias("keep_doc"), (F.col("keep") - doc.cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(12,0)")).cast("int").alias("keep_pos")))
    rows = semi_by_bitmap(lines_of(docs).select("doc_id", "pos", "k1", "k2"), "k1", kept, bits=1 << 25)
    gone = rows.join(kept, ["k1", "k2"]).filter("doc_id <> keep_doc or pos <> keep_pos")
    gone = checkpoint(gone.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "k1")).alias("gone")))
    discard(classes, links, grouped, kept)
    return gone


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with text reduced to its kept lines, and n_lines, n_removed."""
    gone = doomed_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), threshold)
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = left_join_marked(docs.select(*others), "doc_id", gone)
    text, lost = F.col("row.text"), F.col("gone")
    lines = F.split(text, "\n")
    # a position alone would be wrong where rows of one doc_id hold different texts
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.transform(lost, lambda g: g["pos"]), i) | ~F.array_contains(lost, F.struct(i.alias("pos"), F.xxhash64(normal(x)).alias("k1"))))
    joined = joined.withColumn("_kept", F.when(lost.isNotNull(), kept))
    columns = [F.when(lost.isNull(), text).otherwise(F.array_join("_kept", "\n")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in others]
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return joined.select(*columns, size(lines).alias("n_lines"), F.when(lost.isNull(), F.lit(0).cast("long")).otherwise(size(lines) - size(F.col("_kept"))).alias("n_removed"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
