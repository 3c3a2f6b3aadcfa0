"""File readers and writers (A): JSON lines, CSV, golden sets, result tables, report snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.operators.tables import publish

QUESTION = "struct<question_id: string, question: string, expected_article_ids: array<bigint>, top_k: int>"


def read_jsonl(spark: SparkSession, path: str, schema: str, max_records: int | None = None) -> DataFrame:
    """A1: one record a line; blank and malformed lines are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if max_records is None else df.limit(max_records)


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_clean_papers(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(article_id, text): rows with both, one an id (the first text in order), at most `limit` of them by id."""
    rows = _csv(spark, path, "article_id string, text string").select(F.expr("try_cast(btrim(article_id) AS BIGINT)").alias("article_id"), "text")
    rows = rows.filter("article_id IS NOT NULL AND btrim(text) <> ''").groupBy("article_id").agg(F.min("text").alias("text"))
    return rows if limit is None else rows.orderBy("article_id").limit(limit)


def read_golden(spark: SparkSession, path: str, top_k: int = 5) -> DataFrame:
    """Golden questions from files that hold a list, or an object with `questions`. A question without expected ids or with a
    top_k below 1 is an error."""
    text = spark.read.option("wholetext", True).text(path)
    asked = F.coalesce(F.from_json("value", f"struct<questions: array<{QUESTION}>>")["questions"], F.from_json("value", f"array<{QUESTION}>"))
    rows = text.select(F.explode(asked).alias("q")).select("q.*").withColumn("top_k", F.coalesce("top_k", F.lit(top_k)))
    fine = (F.size("expected_article_ids") > 0) & (F.col("top_k") >= 1)
    return rows.withColumn("top_k", F.when(fine, F.col("top_k")).otherwise(F.raise_error(F.concat(F.lit("golden question "), "question_id", F.lit(" needs expected ids and a top_k of 1 or more"))).cast("int")))


def read_answer_golden(spark: SparkSession, path: str) -> DataFrame:
    """A10: answer golden set; key terms are parted by semicolons, blank ones left out."""
    rows = _csv(spark, path, "gold_id string, question string, expected_article_id bigint, expected_title string, key_terms string")
    terms = F.filter(F.transform(F.split(F.coalesce("key_terms", F.lit("")), ";"), lambda t: F.btrim(t)), lambda t: t != "")
    return rows.withColumn("key_terms", terms)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, topic) of an assignment CSV; rows with a blank in either are skipped, topics may be written as 3.0."""
    header = spark.read.option("header", True).csv(path).columns
    if not {"article_id", "topic"} <= set(header):
        raise ValueError("an assignment CSV must have the columns article_id and topic")
    rows = spark.read.option("header", True).csv(path).filter("btrim(article_id) <> '' AND btrim(topic) <> ''")
    return rows.select(F.col("article_id").cast("long").alias("article_id"), F.col("topic").cast("double").cast("int").alias("topic"))


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One directory a table; each is replaced as a whole."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).option("escape", '"').csv if kind == "csv" else writer.json if kind == "json" else writer.parquet)(f"{folder}/{name}")


def flat(df: DataFrame) -> DataFrame:
    """df for CSV: arrays, maps and structs as JSON text."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_hygiene(result, topic_input: DataFrame, folder: str) -> None:
    """Clean, topic_input, removed, duplicates and metrics as CSV."""
    tables = {"clean": result.clean, "topic_input": topic_input, "removed": result.removed, "duplicates": result.duplicates, "metrics": result.metrics}
    write_tables({k: flat(df) for k, df in tables.items()}, folder, "csv")


def write_topics(folder: str, info: DataFrame, assignments: DataFrame, keywords: DataFrame, experiments: DataFrame) -> None:
    """Topic info, assignments, keywords and experiment rows as CSV."""
    write_tables({"info": flat(info), "assignments": flat(assignments), "keywords": flat(keywords), "experiments": flat(experiments)}, folder, "csv")


def write_eval_report(folder: str, run_id: str, suite: str, as_of: str, clustering: DataFrame | None = None, results: DataFrame | None = None, summary: DataFrame | None = None) -> None:
    """A16, below folder/run_id: clustering_metrics as JSON, retrieval_results as CSV with a row a question, and one JSON row of the
    run with both summaries (clustering and summary have one row each)."""
    root = f"{folder}/{run_id}"
    spark = next(df for df in (clustering, results, summary) if df is not None).sparkSession
    run = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(suite).alias("suite"), F.lit(as_of).alias("generated_at"))
    if clustering is not None:
        write_tables({"clustering_metrics": clustering}, root, "json")
        run = run.crossJoin(clustering.select(F.struct("*").alias("clustering")))  # one row each
    if results is not None:
        write_tables({"retrieval_results": flat(results)}, root, "csv")
        counted = results.agg(F.count(F.lit(1)).alias("question_count"))
        one = counted if summary is None else counted.crossJoin(summary.select(F.struct("*").alias("summary")))
        run = run.crossJoin(one.select(F.struct("*").alias("retrieval")))
    write_tables({"summary": run}, root, "json")


class SnapshotStore:
    """Report tables by key, each in a folder of its own. A save writes aside and then takes the place of the key's table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, key: str, df: DataFrame) -> None:
        made = f"{self.folder}-new/{uuid.uuid4().hex}"
        df.write.parquet(made)
        publish(self.spark, made, f"{self.folder}/{key}")

    def get(self, key: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{key}") if self._fs.exists(self._path(f"{self.folder}/{key}/_SUCCESS")) else None

    def keys(self) -> list[str]:
        root = self._path(self.folder)
        return sorted(n for s in self._fs.listStatus(root) if ".old-" not in (n := s.getPath().getName())) if self._fs.exists(root) else []

    def delete(self, prefix: str) -> int:
        gone = [k for k in self.keys() if k.startswith(prefix)]
        for k in gone:
            self._fs.delete(self._path(f"{self.folder}/{k}"), True)
        return len(gone)

    def refresh(self, key: str, make) -> DataFrame:
        """The stored table; made and stored first where there is none."""
        if (found := self.get(key)) is None:
            self.save(key, make())
            found = self.get(key)
        return found


def latest_of(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
