"""Token-count rollups that are maintained by signed deltas.

A batch of changes is (op, doc_id, source, lang, tokenizer, tokens, old_tokens): an insert adds a document and its tokens,
a delete takes both away, a revision replaces old_tokens by tokens. Each batch is summed to one signed row per (source,
lang, tokenizer) and written to its own folder `batch=<id>`, whole or not at all; writing it again replaces that folder, so
a batch that is retried or sent twice counts once. Totals are the sums over the committed batches.

Defined cases: null source, lang or tokenizer is a group of its own; null token counts count as 0; an unknown op is an
error; an empty batch commits no rows; repeated change rows are separate changes (a log, not a set).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.common import checkpoint, read_table, shared_folder

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows (docs, tokens) per group: partial sums on the map side, one row per group and batch."""
    op, new, old = F.col("op"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long"), F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
    return changes.select(*KEYS, docs.cast("long").alias("docs"), tokens.alias("tokens")).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def apply(self, batch_id: int, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before. _SUCCESS is the commit mark that Spark's writer leaves last."""
        if self._has(f"batch={batch_id}/_SUCCESS"):
            return False
        signed(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        return True

    def committed(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        ids = [int(n[6:]) for n in names if n.startswith("batch=")]
        return sorted(i for i in ids if self._has(f"batch={i}/_SUCCESS"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches, without groups that came to nothing."""
        paths = [f"{self.folder}/batch={i}" for i in self.committed()]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over documents, each sent twice: estimates of tokens (n_chars div 4), revised to the words of the
    whole text; then every later copy of a text is deleted."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"), F.expr("n_chars div 4").alias("guess"), n_words(F.col("text")).alias("words"), F.xxhash64("text").alias("h1"), F.hash("text", F.lit(7)).alias("h2"), F.length("text").alias("len"))
    docs = checkpoint(docs)  # counted once, read by all batches
    first = docs.groupBy("h1", "h2", "len").agg(F.min("doc_id").alias("first"))
    copies = docs.join(first, ["h1", "h2", "len"]).filter(F.col("len").isNotNull() & (F.col("doc_id") > F.col("first")))
    group = ["doc_id", *KEYS]
    batches = {
        1: docs.select(*group, F.lit("insert").alias("op"), F.col("guess").alias("tokens"), F.lit(None).cast("long").alias("old_tokens")),
        2: docs.select(*group, F.lit("revise").alias("op"), F.col("words").alias("tokens"), F.col("guess").alias("old_tokens")),
        3: copies.select(*group, F.lit("delete").alias("op"), F.col("words").alias("tokens"), F.lit(None).cast("long").alias("old_tokens")),
    }
    rollup = Rollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    for batch_id in (1, 2, 2, 3, 1):  # retries change nothing
        rollup.apply(batch_id, batches[batch_id])
    return rollup.totals()


ORACLE = r"""
WITH d AS (SELECT doc_id, source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
                  CASE WHEN text IS NULL THEN FALSE ELSE doc_id > min(doc_id) OVER (PARTITION BY text) END AS copy FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(words) AS BIGINT) AS tokens
FROM d WHERE NOT copy GROUP BY source, lang
"""
