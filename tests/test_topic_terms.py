"""Topic terms against plain counts, and the work they take."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from litlens.operators import topics as E
from litlens.plans.base import articles


def test_terms_and_weights_by_hand(spark):
    rows = [(1, 0, "alpha beta beta"), (2, 0, "beta gamma the alpha"), (2, 0, "delta"), (3, 1, "alpha beta"), (4, 1, ""), (5, -1, "delta delta"), (6, 1, None), (7, 1, "gamma omega"), (None, 0, "omega solo"), (8, 2, "solitary solitary")]
    df = spark.createDataFrame(rows, "id int, cluster_id int, t string").repartition(3)
    tf, docs = Counter(), defaultdict(set)
    for i, c, t in rows:
        w = [x for x in (t or "").split() if x != "the"] if c >= 0 else []
        for term in w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]:
            tf[c, term] += 1
            docs[term].add((i, c))
    for least in (1, 2, 3):
        got = {(r["cluster_id"], r["term"]): r["tf"] for r in E.topic_terms(df, F.col("t"), least).collect()}
        assert got == {k: n for k, n in tf.items() if len(docs[k[1]]) >= least}
    kept = {k: n for k, n in tf.items() if len(docs[k[1]]) >= 2}
    length, total = Counter(), Counter()
    for (c, term), n in kept.items():
        length[c] += n
        total[term] += n
    mean = sum(length.values()) / len(length)
    got = {(r["cluster_id"], r["term"]): r["weight"] for r in E.ctfidf(E.topic_terms(df, F.col("t"))).collect()}
    assert got.keys() == kept.keys()
    assert all(math.isclose(got[k], math.sqrt(n / length[k[0]]) * math.log(1 + mean / total[k[1]]), rel_tol=1e-12) for k, n in kept.items())


def test_words_are_found_once(spark, sf):
    """words are found once a row, terms meet no shuffle by document, and no class lies in one task."""
    terms = E.topic_terms(articles(spark, sf))
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert not any("hashpartitioning(id" in line and "term" in line for line in plan.splitlines())
    weights = E.ctfidf(terms)._jdf.queryExecution().optimizedPlan().toString()
    assert weights.count("Window [") == 1
