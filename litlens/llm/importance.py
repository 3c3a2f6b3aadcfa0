"""Importance resampling towards a target: documents drawn in proportion to how likely their words are in a target corpus.

Features are all runs of 1 to `longest` consecutive words, hashed to `buckets` buckets. A batch's texts are joined with a
separator sentinel; one regular expression finds the words of all of them, the documents' offsets (searchsorted) tell whose
they are, runs that cross a document are masked, and bincount sums up what is left. Bucket counts of the whole corpus and the
whole target give each bucket a gain (log ratio of smoothed shares); a document's weight is the floored mean of its gains, and
a Gumbel noise of its key turns the highest scores into a draw without replacement. Ranks come from a range-partitioned sort,
so that no task sees more than its range.

Two passes over the texts, one shuffle of `buckets` counts a task and one of the small scored rows. Only the counts, whose
number is a parameter, reach the driver.

Defined cases: a null text has no words; a null key is hashed as an empty one and stands before other keys in ties; rows that
repeat a document are documents of their own (the noise follows the key, so they have equal scores; both can be drawn); empty
tables give empty results or, as a target, gains of the corpus alone; very long texts are a batch of their own; words longer
than 64 bytes go to zlib. Kept columns named n_features, n_words, weight, score or rank are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.llm.common import checkpoint, partitions, read_table
from litlens.llm.words import pieces, slices

BUCKETS = 10_000
LONGEST = 2
#: Words, after A-Z became a-z, as UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Between two texts; no word holds it.
SENTINEL = b"\x00"
RESULTS = [T.StructField("n_features", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())]
#: Bytes of a word that are hashed column by column.
SHORT = 64
FULL = 0xFFFFFFFF


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _table()


def feed(register: np.ndarray, data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes from start to end of each element."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    out, at, size = register[order], start[order], size[order]
    n_long = int(np.searchsorted(-size, -SHORT, side="left"))
    for i in range(n_long):
        out[i] = zlib.crc32(raw[at[i] : at[i] + size[i]], int(out[i]) ^ FULL) ^ FULL
    for k in range(int(size[n_long]) if n_long < len(size) else 0):
        m = int(np.searchsorted(-size, -k, side="left"))  # words of more than k bytes
        now = out[n_long:m]
        out[n_long:m] = CRC[(now ^ data[at[n_long:m] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and text of each feature, number of words of each text)."""
    raw = SENTINEL.join(texts).lower() + SENTINEL
    data = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    spans = np.fromiter(chain.from_iterable(m.span() for m in WORD.finditer(raw)), np.int64).reshape(-1, 2)
    start, end = spans[:, 0], spans[:, 1]
    owner = np.searchsorted(starts, start, side="right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    found, of = [], []
    register, first = np.full(len(start), FULL, np.uint32), np.arange(len(start))
    for n in range(longest):
        if n:
            inside = first + n < len(start)
            first, register = first[inside], register[inside]
            inside = owner[first] == owner[first + n]  # a run that leaves its document is none
            first, register = first[inside], register[inside]
            register = CRC[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8))
        register = feed(register, data, raw, start[first + n], end[first + n])
        found.append((register ^ np.uint32(FULL)).astype(np.int64) % buckets)
        of.append(owner[first])
    return np.concatenate(found), np.concatenate(of), n_words


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows. The result has `buckets` numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            texts = _texts(batch, "text")
            for a, b in pieces(texts):
                total += np.bincount(features(texts[a:b], longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share of the target to that of the corpus, floored."""
    all_corpus, all_target, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float(t + 1) * float(all_corpus + n) / (float(s + 1) * float(all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(key: str) -> int:
    """1000 times a Gumbel number that the key fixes, floored."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None, longest: int = LONGEST, seed: int = 7) -> DataFrame:
    """keep (all columns of docs unless given) with n_features, n_words, weight, score."""
    names = {f.name for f in RESULTS} | {"rank"}
    keep = tuple(c for c in (keep or docs.columns) if c not in names)
    schema = T.StructType([*docs.select(*keep).schema.fields, *RESULTS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys = _texts(batch, "_text"), batch.column("_key").to_pylist()
            sums, n_features, n_words = [], [], []
            for a, b in pieces(texts):
                bucket, owner, words = features(texts[a:b], longest, len(gain))
                sums.append(np.bincount(owner, weights=gain[bucket], minlength=b - a).astype(np.int64))  # exact below 2^53
                n_features.append(np.bincount(owner, minlength=b - a))
                n_words.append(words)
            n = np.concatenate(n_features)
            weight = np.concatenate(sums) // np.maximum(n, 1)
            shift = np.array([noise(f"{seed}:{'' if k is None else k}") for k in keys], np.int64)
            made = [pa.array(x.astype(np.int64)) for x in (n, np.concatenate(n_words), weight, weight + shift)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=schema.names)

    return docs.select(*keep, F.col(key).cast("string").alias("_key"), F.col(text).alias("_text")).mapInArrow(score, schema)


def draw(weighed: DataFrame, key: str = "doc_id", percent: int = 25, min_words: int = 20) -> DataFrame:
    """weighed without n_words, with rank: the floor(percent * N / 100) highest scores of the N rows with enough words, ties to
    the smaller key; null for all others."""
    may = F.col("n_words") >= min_words
    order = [F.when(may, 0).otherwise(1), F.col("score").desc(), F.col(key).asc_nulls_first()]
    weighed = checkpoint(weighed)  # the sort reads it twice, to find its ranges and to deal the rows
    # in one stage: the partition in the upper bits, the place in it in the lower ones
    placed = checkpoint(weighed.repartitionByRange(partitions(weighed), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(may).alias("_may"))
    # a row for each partition of the sort: they go in one task, and to all
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy()
    sizes = sizes.select("_part", before.alias("_before"), F.floor(percent * F.sum("_may").over(every) / F.lit(100)).cast("long").alias("_drawn"))
    out = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    rank = F.col("_before") + place + 1
    return out.withColumn("rank", F.when(may & (rank <= F.col("_drawn")), rank)).drop("_part", "_at", "_before", "_drawn", "n_words")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", keep: tuple[str, ...] | None = None, percent: int = 25, min_words: int = 20, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """docs (or the columns keep of them) with n_features, weight, score and rank towards target's texts."""
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    return draw(weigh(docs, gain, key, text, keep, longest, seed), key, percent, min_words)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return resample(docs.select("doc_id", "text"), target, keep=("doc_id",)).select("doc_id", "n_features", "weight", "score", "rank")
