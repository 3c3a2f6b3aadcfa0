"""Benchmark decontamination by SimHash over item-sized windows.

An item is a benchmark text; its size is its number of words (runs of letters and digits, in lower case). For every size of an
item, windows of that size slide over each document word by word; a document shorter than an item is one window. Windows
without any shingle of an item of their size have similarity 0 and are skipped, which loses nothing. The other windows get a
64-bit SimHash of their weighted five-word shingles. A multi-index finds all items within `radius` bits: the fingerprint is
cut into four 16-bit blocks, one of which must lie within radius // 4 bits of the item's, and a table lists the items near
each block value. Candidates of the window's size are verified: weighted Jaccard similarity of the shingle counts, weights
ln(1 + items / items with the shingle). Items of fewer than five words are one shingle of their own length.

Two sets at Jaccard 0.8 differ in 9.7 of 64 bits on average with a standard deviation of 2.9; the radius of 19 is more than
three deviations above. Items are handled in shards of about `SHARD` items and `SHARD_BYTES` bytes, each broadcast alone, so the
broadcast has a fixed bound. Items and holders of each shingle are counted over the whole benchmark beforehand, so matches do
not depend on the shards.

Defined cases: null and empty texts match nothing, as items or documents; a null doc_id is matched and reported like any
other; repeated document rows are matched one by one, repeated items count as items of their own; empty tables give no
matches; other columns pass through `remove` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.common import checkpoint, read_table, union_all
from litlens.llm.words import MARKS, mix, pieces, shingle_hashes, slices, word_hashes

SHINGLE, RADIUS, SHARD, SHARD_BYTES = 5, 19, 2048, 8_000_000
_SHIFTS = np.arange(64, dtype=np.uint64)
_WEIGHTS_OF_BITS = np.uint64(1) << _SHIFTS
_POPULATION = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return ((mix(h)[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.float32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) * _WEIGHTS_OF_BITS).sum(1, dtype=np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_POPULATION[((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64) for s in (0, 16, 32, 48))


class Items:
    """One shard of benchmark items: shingles, weights, fingerprints and the multi-index. held: how many items of the whole
    benchmark hold each shingle of the shard's, and how many items have words; without it the shard is the benchmark."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, radius: int, held: tuple[dict[int, int], int] | None = None):
        self.threshold, self.radius = threshold, radius
        raw = [(t or "").lower().encode("utf-8", "replace") for _, t in rows]
        h, first, _, _ = word_hashes(raw or [b""], MARKS)
        size = np.diff(first) if raw else np.empty(0, int)
        self.ids = [rows[i][0] for i in np.flatnonzero(size)]
        self.size = size[size > 0].tolist()
        self.k = [min(SHINGLE, n) for n in self.size]
        self.sets: list[Counter] = []
        for i, k in zip(np.flatnonzero(size), self.k, strict=True):
            s, _ = shingle_hashes(h[first[i] : first[i + 1]], np.array([0, size[i]]), k)
            self.sets.append(Counter(s.tolist()))
        df, n = held or (Counter(x for s in self.sets for x in s), len(self.sets))
        self.unknown = float(np.log1p(n))
        self.weight = {x: float(np.log1p(n / c)) for x, c in df.items()}
        self.holders: dict[int, dict[int, list[int]]] = {}
        for i, (s, k) in enumerate(zip(self.sets, self.k, strict=True)):
            for x in s:
                self.holders.setdefault(k, {}).setdefault(x, []).append(i)
        self.vocabulary = {k: np.array(sorted(v), np.uint64) for k, v in self.holders.items()}
        prints = [packed((signs(np.array(list(s), np.uint64)) * np.array([self.weight[x] * c for x, c in s.items()], np.float32)[:, None]).sum(0, keepdims=True)) for s in self.sets]
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.near: list[dict[int, np.ndarray]] = [{}, {}, {}, {}]

    def within(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint number, item number) of all pairs within the radius."""
        a, b = [], []
        for block in range(4):
            own = ((self.prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            value = ((fingerprints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            table = self.near[block]
            for v in np.unique(value):
                if int(v) not in table:
                    table[int(v)] = np.flatnonzero(_POPULATION[own ^ v] <= self.radius // 4)
                items, who = table[int(v)], np.flatnonzero(value == v)
                a.append(np.repeat(who, len(items)))
                b.append(np.tile(items, len(who)))
        pair = np.unique(np.concatenate(a) * len(self.prints) + np.concatenate(b))
        a, b = pair // len(self.prints), pair % len(self.prints)
        close = distance(fingerprints[a], self.prints[b]) <= self.radius
        return a[close], b[close]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        x, y = Counter(window.tolist()), self.sets[item]
        w = lambda s: self.weight.get(s, self.unknown)
        low = sum(w(s) * min(c, y[s]) for s, c in x.items() if s in y)
        high = sum(w(s) * max(c, y.get(s, 0)) for s, c in x.items()) + sum(w(s) * c for s, c in y.items() if s not in x)
        return low / high if high else 0.0

    def matches(self, words: np.ndarray, k: int, shingles: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item of shingle length k in one document."""
        vocabulary = self.vocabulary[k]
        at = np.minimum(np.searchsorted(vocabulary, shingles), len(vocabulary) - 1)
        hits = np.flatnonzero(vocabulary[at] == shingles)
        if not len(hits):
            return []
        sizes: dict[int, set[int]] = {}
        for p in hits.tolist():
            for i in self.holders[k][int(shingles[p])]:
                sizes.setdefault(self.size[i], set()).add(p)
        best: dict[int, tuple[float, int, int]] = {}
        for size, places in sizes.items():
            n = min(size, len(words))
            span = max(n - k + 1, 1)  # shingles of a window
            last = len(shingles) - span
            starts = sorted({s for p in places for s in range(max(0, p - span + 1), min(p, last) + 1)})
            for a in range(0, len(starts), 4096):
                part = np.array(starts[a : a + 4096])
                # sums over each stretch of neighbouring windows
                for run in np.split(part, np.flatnonzero(np.diff(part) > span) + 1):
                    lo, hi = run[0], run[-1] + span
                    s = shingles[lo:hi]
                    w = np.array([self.weight.get(x, self.unknown) for x in s.tolist()], np.float32)
                    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signs(s) * w[:, None], 0, dtype=np.float64)])
                    prints = packed(np.round(sums[run - lo + span] - sums[run - lo], 4))
                    for f, i in zip(*self.within(prints), strict=True):
                        if self.size[i] == size and self.k[i] == k:
                            start = int(run[f])
                            score = self.similarity(shingles[start : start + span], int(i))
                            if score >= self.threshold and (i not in best or (-score, start) < (-best[i][0], best[i][1])):
                                best[i] = (score, start, n)
        return [(i, *x) for i, x in sorted(best.items())]

    def of_texts(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        raw, out = [(t or "").lower().encode("utf-8", "replace") for t in texts], [[] for _ in texts]
        for a, b in pieces(raw):
            h, first, _, _ = word_hashes(raw[a:b], MARKS)
            for k, vocabulary in self.vocabulary.items():
                s, at = shingle_hashes(h, first, k)
                hit = vocabulary[np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)] == s
                for d in np.unique(np.searchsorted(at, np.flatnonzero(hit), side="right") - 1):
                    out[a + d] += self.matches(h[first[d] : first[d + 1]], k, s[at[d] : at[d + 1]])
        return out


def counted(benchmark: DataFrame) -> DataFrame:
    """(row, item_id, text, held): every item once more, with (shingle, items of the benchmark that hold it)."""
    kind = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, first, _, _ = word_hashes([(text or "").lower().encode("utf-8", "replace")], MARKS)
                s, _ = shingle_hashes(h, first, max(1, min(SHINGLE, len(h))))
                out.append({"item_id": item, "text": text, "shingles": np.unique(s).astype(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, kind)

    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = slim.mapInArrow(run, "item_id long, text string, shingles array<long>").filter(F.size("shingles") > 0)
    items = checkpoint(items.withColumn("row", F.monotonically_increasing_id()))  # written, so that the numbers stay
    each = items.select("row", F.explode("shingles").alias("shingle"))
    held = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "n")).alias("held"))
    return checkpoint(items.drop("shingles").join(held, "row"))


def shards(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], tuple[dict[int, int], int]]]:
    """The items, about SHARD and SHARD_BYTES of them at a time, with what Items needs to know of the others."""
    items = counted(benchmark)
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // SHARD), -(-size // SHARD_BYTES))
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).orderBy("item_id", "text", "row").collect()
        yield [(r["item_id"], r["text"]) for r in rows], ({h["shingle"] % (1 << 64): h["n"] for r in rows for h in r["held"]}, n)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each matching document and item."""

    def search(rows: tuple) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value[0], threshold, radius, shared.value[1])
            for batch in slices(batches):
                ids, out = batch.column(0).to_pylist(), []
                for doc, found in zip(ids, items.of_texts(batch.column(1).to_pylist()), strict=True):
                    out += [{"doc_id": doc, "item_id": items.ids[i], "similarity": score, "start_word": start, "n_words": n} for i, score, start, n in found]
                yield pa.RecordBatch.from_pylist(out, fields)

        return slim.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long")

    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return union_all([search(rows) for rows in shards(benchmark)])


def remove(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """docs without the documents that match an item; a scan for each shard of items, no shuffle."""
    out, at = docs, docs.columns.index("text")

    def keep(rows: tuple, df: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value[0], threshold, radius, shared.value[1])
            for batch in slices(batches):
                yield batch.filter(pa.array([not m for m in items.of_texts(batch.column(at).to_pylist())], pa.bool_()))

        return df.mapInArrow(run, docs.schema)

    for rows in shards(benchmark):
        out = keep(rows, out)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
