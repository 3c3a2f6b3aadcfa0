"""Jaccard self-join of documents over word shingles by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Two documents link when the Jaccard similarity
of their sets is at least `percent` / 100.

* Equal sets are one node (a group of copies is one node, however large).
* Tokens are ordered by (class, hash). Class 1 is rare; class 2 holds the tokens of at least `frequent_from` documents, at
  most `frequent_most` of them, the most frequent ones. As any classing that is the same everywhere gives whole results, the
  bound keeps the broadcast small (8 bytes a token) without losing a link. Document frequencies cover all documents.
* Up to floor(n * (100 - percent) / 100) tokens of a set of n may be missing from its partner. A prefix is extended until
  the loss of that many tokens still leaves a rare token or a pair of frequent ones: rare tokens count 1 each, the frequent
  ones of a subclass one less than their number. Every linked pair then shares an indexed token or pair.
  Proof: take the set whose prefix ends first in the order. All common tokens up to there lie in both prefixes; were no
  token and no pair shared, more tokens of it would be missing than may be.
* Pairs are formed within subclasses (token hash mod m), so that their number stays near the prefix's length. m depends on
  the band of the set's size; as partners' sizes differ by at most 100 / percent, a set indexes the bands it may share.
* A pair whose first shared token stands so late in one of the sets that too little is left to share is no candidate, nor is
  one whose sets differ in more tokens than they may: the parities of 256 hash bins bound that from below, and before texts are
  read or all pairs of a bucket formed, those of about as many bins as a set has tokens.
* In each bucket, members are compared with two centres: the nodes with the fewest and with the most tokens of their own
  before. Verified links make components. Members of a bucket that lie outside the component of one of `HEADS` further members
  (in as many hash orders) are compared with it, and what then still lies in different components, every pair of it whose sizes
  are near. So no link between components is missed, and groups of near copies never expand into all pairs. Buckets of the same
  members are one for these steps.
* A caller that needs the number of links (count_links) has them counted inside each component: its nodes are dealt to blocks of
  bounded size by their set's size, and each pair of blocks whose sizes can link meets in one task, as an incidence matrix.

Defined cases: null text is an empty text; documents without words have no set, link with nothing and are their own
component; a null doc_id keeps its n_shingles and has a null component unless a linked document has an id; rows of
one doc_id give one result row each and are judged by their own sets; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.llm.common import checkpoint, components, discard, left_join_marked, partitions, read_table, semi_by_bitmap, small_batches
from litlens.llm.words import mix, pieces, planes, shingle_hashes, slices, unplanes, word_hashes

#: Upper ends of the bands of set sizes, and pair subclasses in each (an eighth of the band's lower end).
BANDS = [64, 512, 4096, 32_768, 262_144, 1 << 62]
SUBCLASSES = [1, 8, 64, 512, 4096, 32_768]
#: Bits of a token's hash that are counted together; range partitions of the counts a million tokens apart.
COUNT_BITS = 40
#: Bits of a set's identity; above them an index row carries how early in the set's order the indexed token stands, in 32
#: steps from the end of the prefix (31: at its start).
NODE_BITS, STEPS = 58, 32
M = ("m0", "m1", "m2", "m3")
#: Wider parities: 64-bit words, and the sizes of the sets that carry them. Neighbours overlap by more than two linked sets may
#: differ in size, so a linked pair has one kind in common, with about as many bins as a set has tokens.
WIDE = {"o1": (16, 150, 2_800), "o2": (64, 1_700, 11_200), "o3": (256, 6_800, 1 << 62)}
#: Members of a bucket that one task compares with the others.
CROWD = 1024
#: Further members of a mixed bucket that others are compared with; nodes and shingles of a block in which links are counted,
#: and columns of its incidence matrix at a time.
HEADS, BLOCK_NODES, BLOCK_TOKENS, COLUMNS = 6, 256, 400_000, 8192


def sets_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, out = [(t or "").encode("utf-8", "replace") for t in texts], []
    for a, b in pieces(raw):
        h, first, _, _ = word_hashes(raw[a:b])
        s, at = shingle_hashes(h, first, words)
        out += [np.unique(s[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


def fingerprint(s: np.ndarray) -> int:
    """Identity of a set (never of an empty one); the set's size is part of it."""
    h = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(keepdims=True) + mix(np.array([len(s)], np.uint64))
    return int((h >> np.uint64(64 - NODE_BITS)).astype(np.int64)[0])


def parities(s: np.ndarray, words: int = 4) -> np.ndarray:
    """64-bit words (a power of two): for each of 64 * words bins of hashes, whether the set has an odd number of tokens in it.
    The words of two sets differ in at most as many bits as tokens are in one set alone."""
    bins = 64 * words
    odd = np.bincount((mix(s ^ np.uint64(0xB5026F5AA96619E9)) >> np.uint64(65 - bins.bit_length())).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parities(s: np.ndarray) -> list[np.ndarray | None]:
    """The kinds of WIDE that a set of this size carries; null for the others."""
    return [parities(s, words) if least <= len(s) <= most else None for words, least, most in WIDE.values()]


def wide_room(percent: int) -> Column:
    """Whether the wide parities of sets a and b leave room for a link: tokens in one set alone are at least their distance."""

    def room(c: str) -> Column:
        apart = F.expr(f"aggregate(zip_with({c}_a, {c}_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
        return F.col(f"{c}_a").isNull() | F.col(f"{c}_b").isNull() | ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))

    return reduce(lambda x, y: x & y, [room(c) for c in WIDE])


def with_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, n, node, m0 to m3, o1 to o3): size, identity and parities of each document's set; node is null for an empty
    set. th tells texts of one doc_id apart."""
    names = ["doc_id", "th", "n", "node", *M, *WIDE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = sets_of(batch.column(1).to_pylist(), words)
            node = [fingerprint(s) if len(s) else None for s in sets]
            odd = np.array([parities(s) for s in sets], np.int64).reshape(-1, 4)
            wide = zip(*[wide_parities(s) for s in sets], strict=True) if sets else [()] * len(WIDE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), *(pa.array(odd[:, i]) for i in range(4)), *(pa.array(list(x), pa.list_(pa.int64())) for x in wide)], names)

    kinds = ", ".join(f"{c} {'array<long>' if c in WIDE else 'long'}" for c in names)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, kinds)


def frequent_tokens(docs: DataFrame, words: int, least: int, most: int, ranges: int) -> np.ndarray:
    """Sorted hashes (COUNT_BITS high bits) of the `most` most frequent tokens that at least `least` documents hold.

    Each task sends its counted tokens as sorted, delta-coded runs, one for each range of hashes.
    """
    shift = np.uint64(64 - COUNT_BITS)

    def emit(tokens: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        t, n = np.unique(np.concatenate(tokens) >> shift, return_counts=True)
        cut = np.searchsorted(t, (np.arange(1, ranges, dtype=np.float64) * (2.0**COUNT_BITS / ranges)).astype(np.uint64))
        rows = []
        for r, (x, k) in enumerate(zip(np.split(t, cut), np.split(n, cut), strict=True)):
            if len(x):
                rows.append((r, planes(np.diff(x, prepend=np.uint64(0))), planes(k.astype(np.uint32))))
        yield pd.DataFrame(rows, columns=["r", "tokens", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for s in sets_of(batch.column(0).to_pylist(), words):
                held.append(s)
                size += len(s)
                if size > 4_000_000:
                    for x in emit(held):
                        yield pa.RecordBatch.from_pandas(x, schema=kind, preserve_index=False)
                    held, size = [], 0
        if size:
            for x in emit(held):
                yield pa.RecordBatch.from_pandas(x, schema=kind, preserve_index=False)

    kind = pa.schema([("r", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def total(frame):
        t = np.concatenate([np.cumsum(unplanes(b, "<u8")) for b in frame["tokens"]])
        n = np.concatenate([unplanes(b, "<u4") for b in frame["counts"]])
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        t, n = t[head], np.add.reduceat(n.astype(np.int64), head)
        keep = n >= least
        return pd.DataFrame({"token": t[keep].astype(np.int64), "docs": n[keep]})

    counts = docs.select("text").mapInArrow(count, "r int, tokens binary, counts binary")
    found = counts.groupBy("r").applyInPandas(total, "token long, docs long").orderBy(F.desc("docs"), "token").limit(most)
    return np.sort(np.array([r[0] for r in found.select("token").collect()], np.uint64))  # at most `most` numbers


def band_of(n: int) -> int:
    return next(i for i, top in enumerate(BANDS) if n < top)


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexed hashes of a set (sorted by hash), rare prefix tokens and pairs of frequent ones; and for each the number of the
    set's tokens before it that a partner, sharing this as their first, is sure to lack."""
    n = len(s)
    may_miss = n * (100 - percent) // 100
    t = s >> np.uint64(64 - COUNT_BITS)
    at = np.minimum(np.searchsorted(frequent, t), max(0, len(frequent) - 1))
    often = frequent[at] == t if len(frequent) else np.zeros(n, bool)
    rare, many = s[~often], s[often]
    out, before = [], []
    largest = n * 100 // percent
    for band in range(band_of(n), band_of(largest) + 1):
        salt = np.uint64(0x9E37 * (band + 1))
        singles = rare[: may_miss + 1]
        out.append(mix(singles ^ salt))
        before.append(np.arange(len(singles)))
        lacking = may_miss + 1 - len(singles)
        if lacking > 0:
            sub = many % np.uint64(SUBCLASSES[band])
            # the first frequent token of a subclass adds nothing, every later one adds 1
            order = np.argsort(sub, kind="stable")
            is_first = np.concatenate([[True], sub[order][1:] != sub[order][:-1]]) if len(many) else np.empty(0, bool)
            adds = np.ones(len(many), np.int64)
            adds[order] = ~is_first
            end = int(np.searchsorted(np.cumsum(adds), lacking)) + 1
            part, group = many[:end], sub[:end]
            for g in np.unique(group):
                place = np.flatnonzero(group == g)
                i, j = np.triu_indices(len(place), 1)
                out.append(mix(mix(part[place[i]] ^ salt) + part[place[j]] * np.uint64(0xC2B2AE3D27D4EB4F)))
                # before the first shared pair of any subclass, each other subclass may share one token
                before.append(np.maximum(len(rare) + place[i] - (SUBCLASSES[band] - 1), 0))
    sig, first = np.unique(np.concatenate(out), return_index=True)
    return sig, np.concatenate(before)[first]


def index(docs: DataFrame, frequent, words: int, percent: int) -> DataFrame:
    """(sig, node): what each node indexes, the node with the earliness of the token above its identity, so that the largest
    node of a bucket, which has the fewest rare tokens before, is its centre. Sets of one shingle equal their partners and
    need no index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = frequent.value, set()
        for batch in slices(batches):
            sig, node = [], []
            for s in sets_of(batch.column(0).to_pylist(), words):
                if len(s) < 2:
                    continue
                f = fingerprint(s)
                if f in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(f)
                x, before = signatures(s, table, percent)
                step = np.minimum(before * STEPS // (len(s) * (100 - percent) // 100 + 1), STEPS - 1)
                sig.append(x)
                node.append(((STEPS - 1 - step.astype(np.int64)) << NODE_BITS) | f)
            if sig:
                rows = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).astype(np.int64)), pa.array(np.concatenate(node))], ["sig", "node"])
                for a in range(0, rows.num_rows, 100_000):
                    yield rows.slice(a, 100_000)

    return docs.select("text").mapInArrow(run, "sig long, node long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, th, text) of the documents that wanted (doc_id) may name; the others stay where they are."""
    return semi_by_bitmap(docs.select("doc_id", "text"), "doc_id", wanted).select("doc_id", F.xxhash64("text").alias("th"), "text")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b) whose sets are similar enough, counted on the whole texts where the wide parities don't rule a
    link out. The texts are shuffled by document once, and once more beside their partner."""
    place = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{d}_{x}") for c, d in (("doc_id", "doc"), ("th", "th"), ("n", "n"), *zip(WIDE, WIDE, strict=True))])
    pairs = pairs.select("a", "b").join(place("a"), "a").join(place("b"), "b").filter(wide_room(percent))
    pairs = checkpoint(pairs.select("a", "b", "doc_a", "th_a", "doc_b", "th_b"))
    texts = texts_of(docs, pairs.select(F.col("doc_a").alias("doc_id")).union(pairs.select("doc_b")).distinct())
    text = lambda x: texts.select(F.col("doc_id").alias(f"doc_{x}"), F.col("th").alias(f"th_{x}"), F.col("text").alias(f"t{x}"))
    both = pairs.join(text("a"), ["doc_a", "th_a"]).join(text("b"), ["doc_b", "th_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = batch.column(0), batch.column(1)
            ok, last = [], (None, None)
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tb != last[0]:
                    last = (tb, sets_of([tb], words)[0])
                x, y = sets_of([ta], words)[0], last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return checkpoint(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct())


def count_links_of(members: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, n_links) of the nodes of members (node, component): each pair of blocks of a component in one task."""
    held = members.groupBy("component").agg(F.count(F.lit(1)).alias("held"))
    members = checkpoint(members.join(held, "component"))
    couples = members.filter("held = 2").select("node", F.lit(1).cast("long").alias("n_links"))  # a component of two is a link
    members = members.filter("held > 2").select("node", "component")
    # sizes of partners lie in the same class or in neighbouring ones
    step = math.log(100 / percent)
    sized = members.join(nodes, "node").select("component", "node", "doc_id", "th", "n", F.floor(F.log("n") / step + 1e-9).alias("level"))
    levels = sized.groupBy("component", "level").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK_NODES), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    levels = checkpoint(levels.select("component", "level", parts.alias("parts")))
    blocks = levels.select("component", "level", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"))
    side = lambda x: blocks.select("component", *[F.col(c).alias(f"{c}_{x}") for c in ("level", "part")])
    meet = side("a").join(side("b"), "component").filter("level_b = level_a + 1 or level_b = level_a and part_b >= part_a")
    key = F.xxhash64("component", "level_a", "part_a", "level_b", "part_b")
    meet = checkpoint(meet.withColumn("pair", key))
    ends = meet.select("component", "pair", F.col("level_a").alias("level"), F.col("part_a").alias("part"), F.lit(0).alias("side"))
    ends = ends.union(meet.filter("level_a <> level_b or part_a <> part_b").select("component", "pair", "level_b", "part_b", F.lit(1)))
    placed = sized.join(levels, ["component", "level"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")) + 1)
    placed = checkpoint(placed.select("component", "level", "part", "node", "doc_id", "th"))
    rows = placed.join(ends, ["component", "level", "part"]).select("doc_id", "th", "node", "pair", "side")
    rows = rows.join(texts_of(docs, placed.select("doc_id").distinct()), ["doc_id", "th"]).select("node", "pair", "side", "text")

    def count(frame):
        frame = frame.drop_duplicates(["node", "side"])  # rows of a document that stands twice in the table
        sets = sets_of(frame["text"].tolist(), words)
        n = np.array([len(s) for s in sets], np.int64)
        token, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        x, y = np.flatnonzero(frame["side"] == 0), np.flatnonzero(frame["side"] == 1)
        alone = not len(y)
        y = x if alone else y
        common = np.zeros((len(x), len(y)), np.float32)
        for a in range(0, len(token), COLUMNS):
            lo, hi = np.searchsorted(at, [a, a + COLUMNS])
            held = np.zeros((len(sets), min(COLUMNS, len(token) - a)), np.float32)
            held[owner[lo:hi], at[lo:hi] - a] = 1
            common += held[x] @ held[y].T
        link = 100 * common.astype(np.int64) >= percent * (n[x][:, None] + n[y][None] - common.astype(np.int64))
        if alone:
            np.fill_diagonal(link, False)
            return pd.DataFrame({"node": frame["node"].to_numpy()[x], "n_links": link.sum(1)})
        return pd.DataFrame({"node": frame["node"].to_numpy()[np.r_[x, y]], "n_links": np.r_[link.sum(1), link.sum(0)]})

    counted = rows.groupBy("pair").applyInPandas(count, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return checkpoint(counted.union(couples))


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """(sig, node, q, component, held) of the buckets of rows (sig, node, q, component) that hold several components; buckets of
    the same members are one, with each member's smallest step. Members are told by their number and two sums of hashes: were
    different ones taken for the same, the bucket would hold all of them, so no pair is lost."""
    sums = {f"x{i}": F.sum(F.shiftright(F.xxhash64("node", F.lit(i)), 28)) for i in range(2)}
    mixed = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("held"), *[c.alias(k) for k, c in sums.items()]).filter("lo <> hi")
    mixed = checkpoint(mixed.select("sig", "held", F.xxhash64("held", *sums).alias("members")))
    held = semi_by_bitmap(rows, "sig", mixed).join(mixed, "sig").groupBy("members", "node").agg(F.min("q").alias("q"), F.min("component").alias("component"), F.max("held").alias("held"))
    out = checkpoint(held.withColumnRenamed("members", "sig"))
    discard(mixed)
    return out


def join(docs: DataFrame, words: int = 5, percent: int = 80, frequent_from: int = 32, frequent_most: int = 1 << 18, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): component_id is the smallest doc_id reachable by links, itself
    included; n_links counts the links of the document's set with other sets. Without count_links the pairs inside a
    component are not compared, components stay whole, and n_links counts only the links that were verified for them."""
    with small_batches(docs.sparkSession):
        return joined(docs, words, percent, frequent_from, frequent_most, count_links)


def joined(docs: DataFrame, words: int, percent: int, frequent_from: int, frequent_most: int, count_links: bool) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    sized = checkpoint(with_sets(slim, words))
    tokens = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # each set's size and the document whose text stands for it; sets that only null ids hold get no document and no links
    nodes = checkpoint(sized.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in (*M, *WIDE)]).select("node", "of.doc_id", "of.th", "n", *M, *WIDE))
    frequent = spark.sparkContext.broadcast(frequent_tokens(slim, words, frequent_from, frequent_most, max(1, tokens // 2_000_000)))
    rows = index(slim.filter("doc_id is not null"), frequent, words, percent).repartition(partitions(docs), "sig")
    w = Window.partitionBy("sig")
    mask = (1 << NODE_BITS) - 1
    bare = lambda c: F.col(c).bitwiseAND(F.lit(mask))
    step = lambda c: (STEPS - 1 - F.shiftright(c, NODE_BITS)).cast("int")
    # one shuffle: buckets of one node go, the others know their earliest and latest node
    kept = rows.withColumns({"low": F.min("node").over(w), "high": F.max("node").over(w), "one": F.min(bare("node")).over(w), "other": F.max(bare("node")).over(w)}).filter("one <> other")
    places = {"node": bare("node"), "q": step("node"), "centre": bare("high"), "q_centre": step("high"), "second": bare("low"), "q_second": step("low")}
    buckets = checkpoint(kept.select("sig", *[c.alias(k) for k, c in places.items()]))
    sizes = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *M)])

    def differ_little() -> Column:
        """Whether the parities of sets a and b leave room for a link: tokens in one set alone are at least their distance."""
        apart_bits = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in M[1:]), F.bit_count(F.col(f"{M[0]}_a").bitwiseXOR(F.col(f"{M[0]}_b"))))
        return (100 + percent) * apart_bits <= (100 - percent) * (F.col("n_a") + F.col("n_b"))

    def may_link(x: str, y: str) -> Column:
        """What the sizes and the tokens that stand before the first shared one leave possible, for set x with partner y."""
        n, m = F.col(f"n_{x}"), F.col(f"n_{y}")
        missed = F.ceil(F.col(f"q_{x}") * (F.floor(n * (100 - percent) / 100) + 1) / STEPS)
        return ((100 + percent) * (n - missed) >= percent * (n + m)) & (100 * n >= percent * m)

    def described(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, q_a, q_b), one for each bucket, as possible pairs. The first shared token stands first in both sets, so
        the smallest steps of a pair belong to it."""
        first = pairs.groupBy("a", "b").agg(F.min("q_a").alias("q_a"), F.min("q_b").alias("q_b"))
        return first.join(sizes("a"), "a").join(sizes("b"), "b").filter(may_link("a", "b") & may_link("b", "a") & differ_little()).select("a", "b")

    def ordered(rows: DataFrame, c: str) -> DataFrame:
        """(a, b, q_a, q_b), a the smaller, of rows with node, q and another node c."""
        swap = F.col("node") > F.col(c)
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        return rows.filter(F.col("node") != F.col(c)).select(pick("node", c).alias("a"), pick(c, "node").alias("b"), pick("q", f"q_{c}").alias("q_a"), pick(f"q_{c}", "q").alias("q_b"))

    def still_apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """(sig, node, q, component, held) of the buckets that hold several components, of buckets of equal members one."""
        apart = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return distinct_buckets(apart)

    tried = checkpoint(described(ordered(buckets, "centre").union(ordered(buckets, "second"))))
    links = verify(tried, nodes, slim, words, percent)
    groups = checkpoint(components(links))
    apart = still_apart(buckets.select("sig", "node", "q"), groups)
    discard(buckets)
    # further centres for what lies in another component than they: a few rows a bucket, whatever it holds
    order = lambda r: F.struct(F.xxhash64("node", F.lit(r)).alias("h"), F.col("node").alias("head"), F.col("q").alias("q_head"), F.col("component").alias("c_head"))
    heads = apart.groupBy("sig").agg(F.array_distinct(F.array(*[F.min(order(r)) for r in range(HEADS)])).alias("heads")).select("sig", F.explode("heads").alias("x")).select("sig", "x.head", "x.q_head", "x.c_head")
    more = described(ordered(apart.join(heads, "sig").filter("component <> c_head"), "head")).join(tried, ["a", "b"], "left_anti")
    more = checkpoint(more)
    links = checkpoint(links.union(verify(more, nodes, slim, words, percent)))
    groups = checkpoint(components(links))
    rest = still_apart(apart.select("sig", "node", "q"), groups)
    rest = rest.join(nodes.select("node", "n", *M, *WIDE), "node").withColumn("parts", F.ceil(F.col("held") / CROWD))
    rest = checkpoint(rest.withColumn("level", F.floor(F.log("n") / math.log(100 / percent) + 1e-9)).drop("held"))
    side = lambda x: rest.select("sig", "level", "parts", F.col("node").alias(x), F.col("q").alias(f"q_{x}"), F.col("component").alias(f"c_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *M, *WIDE)])
    # a set meets those of its own level of sizes and of the next; a large bucket is dealt to several tasks
    left = side("a").withColumn("level", F.explode(F.array("level", F.col("level") + 1))).withColumn("part", F.pmod(F.xxhash64("a"), "parts")).drop("parts")
    right = side("b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    last = left.join(right, ["sig", "level", "part"]).filter(F.expr("(n_a < n_b or n_a = n_b and a < b) and c_a <> c_b") & may_link("a", "b") & may_link("b", "a") & differ_little() & wide_room(percent))
    last = last.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = checkpoint(last.join(tried.union(more), ["a", "b"], "left_anti"))
    if not last.isEmpty():
        links = checkpoint(links.union(verify(last, nodes, slim, words, percent)))
        groups = checkpoint(components(links))
    discard(apart, rest, tried, more, last)
    named = groups.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(named, "component").select("node", "component_id")
    ends = count_links_of(groups, nodes, slim, words, percent) if count_links else links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    per_node = nodes.select("node", F.col("doc_id").alias("first")).join(named, "node", "left").join(ends, "node", "left")
    per_node = per_node.select("node", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sized.select("doc_id", "n", "node").join(per_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are linked, directly or not, with one of a smaller doc_id, or equal one in their set.
    Only documents that may go are shuffled."""
    gone = join(docs, count_links=False, **options).filter("component_id < doc_id").select("doc_id").distinct().withColumn("_goes", F.lit(True))
    return left_join_marked(docs, "doc_id", checkpoint(gone)).filter("_goes is null").select("row.*")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))
