"""The stored index: pruned scans and pages, states, and the same rows as scores of every posting."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litlens.operators import lexicon as L
from litlens.operators import search as G
from litlens.operators import tables as T


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    rows = [(17 * i, " ".join(rnd.choices(common, k=3) + rnd.choices(rare, k=1)), None if i % 50 == 3 else " ".join(rnd.choices(common, k=rnd.randint(3, 40)) + rnd.choices(rare, k=2)), [1.0] if i % 2 else None) for i in range(2500)]
    # one page whose articles repeat a rare word
    rows += [(900_000 + i, "r1 r1 r2", "r1 " * (i % 7 + 1), None) for i in range(60)]
    return rows, spark.createDataFrame(rows, "id long, title string, abstract_text string, embedding array<double>").repartition(4)


def naive(rows, terms, n):
    words = lambda t: re.findall(r"\w+", t.lower())
    docs = {i: (Counter(words(t)), Counter(words(a)), len(words(t)) + len(words(a))) for i, t, a, _ in rows if a is not None}
    mean = sum(x[2] for x in docs.values()) / len(docs)
    df = Counter(w for t, a, _ in docs.values() for w in {*t, *a})
    score = {}
    for i, (t, a, size) in docs.items():
        for w in terms:
            if t[w] or a[w]:
                f = 3 * t[w] + a[w]
                score[i] = score.get(i, 0) + max(1e-6, math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))
    return [(i, round(s, 6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:n]]


def test_same_rows_with_pages_left_out(spark, corpus, monkeypatch):
    rows, articles = corpus
    index = L.opened(articles, f"{T.shared_folder(spark)}/lexicon-test")
    asked = {1: ["r1", "c3"], 2: ["r2", "r7", "c1", "c2"], 3: ["none"], 4: ["c5"], 5: []}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, terms array<string>")
    out = L.search(index, queries, 10)
    got = {q: [] for q in asked}
    for r in out.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], round(r["score"], 6)))
    assert got == {q: naive(rows, t, 10) for q, t in asked.items()}
    # a bound of a page is no less than any score on it, and the best page of query 1 rules out most others
    pages = index.blocks.select("page").distinct().count()
    plan = out._jdf.queryExecution().toString()
    assert pages > 30 and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") and "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "")
    scored = []
    real = G.top
    monkeypatch.setattr(G, "top", lambda df, *a, **k: scored.append(df) or real(df, *a, **k))
    L.search(index, queries.filter("query_id = 1"), 10).collect()
    assert scored[-1].filter("query_id = 1").select(F.floor(F.col("id") / L.PAGE)).distinct().count() < pages / 3


def test_states(spark, corpus):
    _, articles = corpus
    folder = f"{T.shared_folder(spark)}/lexicon-states"
    assert L.status(articles, folder) == "missing"
    L.build(articles, folder)
    assert L.status(articles, folder) == "ok"
    more = articles.unionByName(spark.createDataFrame([(10**7, "new", "one", None)], articles.schema))
    assert L.status(more, folder) == "stale"
    L.opened(more, folder)
    assert L.status(more, folder) == "ok"
    spark.createDataFrame([(None, 1, 1.0, G.K1, G.B, G.TITLE_WEIGHT)], "fingerprint string, n long, avg_length double, k1 double, b double, title_weight double").write.mode("overwrite").parquet(f"{folder}/meta")
    assert L.status(more, folder) == "unknown"
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/meta")
    assert L.status(more, folder) == "unknown"
    empty = L.build(articles.limit(0), f"{folder}-empty")
    assert L.search(empty, spark.createDataFrame([(1, ["c1"])], "query_id int, terms array<string>"), 5).count() == 0


def test_build_grows_by_tasks(spark, corpus, monkeypatch):
    """Pages are dealt over more tasks as articles grow, and blocks that batches split hold the same postings."""
    rows, articles = corpus
    monkeypatch.setattr(L, "TASK_PAGES", 0.1, raising=False)
    monkeypatch.setattr(L, "RUN", 8, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = L.build(articles, f"{T.shared_folder(spark)}/lexicon-tasks")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert index.blocks.select(F.input_file_name()).distinct().count() > 4 * L.BUCKETS
    words = lambda t: Counter(re.findall(r"\w+", t.lower()))
    want = sorted((w, i, words(t)[w], words(a)[w]) for i, t, a, _ in rows if a is not None for w in {**words(t), **words(a)})
    assert sorted(tuple(r) for r in L.postings(index).collect()) == want
    df = Counter(w for w, *_ in want)
    assert {r["term"]: r["df"] for r in index.terms.collect()} == df and index.terms.count() == len(df)
    top = index.blocks.select(F.abs(F.col("top") - F.array_max(F.transform("hits", lambda h: L._part(G.TITLE_WEIGHT * h["tf_title"] + h["tf_abstract"], h["length"], F.lit(index.avg_length))))).alias("d"))
    assert top.agg(F.max("d")).first()[0] < 1e-9
    queries = spark.createDataFrame([(1, ["r1", "c3"])], "query_id int, terms array<string>")
    assert [(r["id"], round(r["score"], 6)) for r in L.search(index, queries, 10).orderBy("rank").collect()] == naive(rows, ["r1", "c3"], 10)


def test_hits_are_added_up_in_as_many_tasks_as_they_need(spark, corpus, monkeypatch):
    """The pages of a query are dealt before their hits are taken out, and summed without another shuffle."""
    _, articles = corpus
    index = L.opened(articles, f"{T.shared_folder(spark)}/lexicon-test")
    queries = spark.createDataFrame([(1, ["c1", "c2", "c3"])], "query_id int, terms array<string>")
    want = L.search(index, queries, 10).collect()
    monkeypatch.setattr(L, "TASK_HITS", 100)
    out = L.search(index, queries, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    tasks = int(re.search(r"hashpartitioning\(query_id#\d+L?, page#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[1])
    hits = index.terms.filter(F.col("term").isin("c1", "c2", "c3")).agg(F.sum("df")).first()[0]
    assert tasks == math.ceil(hits / 100) and "page#" not in "".join(re.findall(r"hashpartitioning\([^)]*\), ENSURE.*", plan))
    assert [tuple(r)[:2] for r in out.collect()] == [tuple(r)[:2] for r in want]
