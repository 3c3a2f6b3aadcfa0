"""Quality classifier: a sparse ensemble of rules that runs as one column expression.

Statistics of each whole text (counts and shares, never its label, language, source or id) feed shallow random-forest
trees. Every path from a root is a conjunctive rule over the statistics; a lasso logistic regression over the 0/1 rules
keeps few of them. The score is the logistic function of the kept rules' weights, compiled to Spark columns, so scoring is
one scan without Python or a shuffle.

Training reads at most `max_train` labelled rows of the folds that are not held out, in the order of a hash of their ids.

Defined cases: a null or empty text has all statistics 0 and gets a score like any other; labels other than 0 and 1 and null
ids are left out of training, of several labels of one document the smallest counts; with fewer than two classes to learn
from the score is the smoothed share of label 1; a null doc_id is not held out; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.common import checkpoint, read_table

#: Rows that training reads at most; folds, of which fold 0 is held out.
MAX_TRAIN, FOLDS = 20_000, 5
#: score >= this is good (fixed value of the query's contract).
CUT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all double, none null."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n, chars, lines = F.col("_words"), F.col("_chars"), F.col("_lines")
    per = lambda c, d: F.when(d > 0, c / d).otherwise(0.0).cast("double")
    count = lambda p: F.regexp_count(F.col("_t"), F.lit(p))
    return {
        "_t": t,
        "_chars": F.length(F.col("_t")),
        "_list": words,
        "_words": F.size(F.col("_list")),
        "_lines": F.regexp_count(F.col("_t"), F.lit("\n")) + 1,
        "log_words": F.log1p(n.cast("double")),
        "word_length": per(chars, n),
        "line_words": per(n, lines),
        "distinct_words": per(F.size(F.array_distinct(F.col("_list"))), n),
        "upper": per(count("[A-Z]"), chars),
        "digits": per(count("[0-9]"), chars),
        "symbols": per(count(r"[#$%&*^~=<>{}\[\]\\]"), chars),
        "bars": per(count(r"\|"), n),
        "shouts": per(count("!"), n),
        "stops": per(count(r"[.?](?:\s|$)"), n),
        "commas": per(count(","), n),
        "capitalised": per(count(r"(?<![^\s])[A-Z][a-z]"), n),
        "marks": per(count(r"[^\p{L}\p{N}\s]"), chars),
        "doubled": per(count(r"([^\p{L}\p{N}\s])\1"), n),
        "short_words": per(F.size(F.filter(F.col("_list"), lambda w: F.length(w) <= 3)), n),
    }


FEATURES = ["log_words", "word_length", "line_words", "distinct_words", "upper", "digits", "symbols", "bars", "shouts", "stops", "commas", "capitalised", "marks", "doubled", "short_words"]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column `_stats`."""
    out = df
    parts = statistics(F.col(text))
    for name in ("_t", "_chars", "_list", "_words", "_lines"):
        out = out.withColumn(name, parts[name])
    return out.withColumn("_stats", F.struct(*[parts[f].alias(f) for f in FEATURES])).drop("_t", "_chars", "_list", "_words", "_lines")


Condition = tuple[int, bool, float]  # statistic, whether it must be above the threshold, threshold


def paths(tree: str) -> set[tuple[Condition, ...]]:
    """Every path from the root in a tree's debug string, as sorted conditions with one bound a side and statistic."""
    found, stack = set(), []
    for line in tree.splitlines():
        m = re.match(r"( +)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (int(m[2]), m[3] == ">", float(m[4]))))
            tight: dict[tuple[int, bool], float] = {}
            for _, (f, above, x) in stack:
                old = tight.get((f, above))
                tight[f, above] = x if old is None else (max if above else min)(old, x)
            found.add(tuple(sorted((f, above, x) for (f, above), x in tight.items())))
    return found


def condition(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for f, above, x in rule:
        c = F.col("_stats")[FEATURES[f]]
        out = out & ((c > x) if above else (c <= x))
    return out


@dataclass
class RuleModel:
    """A fitted ensemble: intercept and weighted rules."""

    intercept: float
    rules: list[tuple[float, tuple[Condition, ...]]] = field(default_factory=list)

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for w, rule in self.rules:
            z = z + F.when(condition(rule), w).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))

    def explain(self) -> list[str]:
        """Readable rules, the heaviest first."""
        text = lambda r: " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {x:.4g}" for f, above, x in r)
        return [f"{w:+.3f}  {text(r)}" for w, r in sorted(self.rules, key=lambda x: -abs(x[0]))]


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, trees: int = 24, depth: int = 3, penalty: float = 0.0008) -> RuleModel:
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_train ids
    rows = with_statistics(rows).select(F.col("y").cast("double").alias("y"), "_stats")
    rows = checkpoint(rows.repartition(8))
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if good in (0, n):
        share = (good + 1) / (n + 2)
        return RuleModel(math.log(share / (1 - share)))
    flat = rows.select("y", *[F.col("_stats")[f].alias(f) for f in FEATURES])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(flat).select("y", "x").cache()
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", subsamplingRate=0.6, minInstancesPerNode=8, seed=11).fit(vectors)
    rules = sorted(set().union(*(paths(t.toDebugString) for t in forest.trees)))
    binary = rows.select("y", *[F.when(condition(r), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)])
    binary = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="r").transform(binary).select("y", "r").cache()
    lasso = LogisticRegression(labelCol="y", featuresCol="r", elasticNetParam=1.0, regParam=penalty, maxIter=80, standardization=True).fit(binary)
    vectors.unpersist()
    binary.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), [(w, r) for w, r in zip(weights, rules, strict=True) if w])


def classify(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with score and predicted."""
    scored = with_statistics(docs).withColumn("score", model.score()).drop("_stats")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return classify(docs, model).select("doc_id", held_out, "score", "predicted")
