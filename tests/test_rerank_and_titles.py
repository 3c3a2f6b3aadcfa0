"""Pair models that fail, facets from one scan, and golden titles without a join of all pairs."""

import random

from litlens.operators import experiments as X
from litlens.operators import reports, retrieval
from litlens.plans import registry
from litlens.plans.base import AS_OF, articles


def ranking(spark):
    rows = [(q, i, r, "alpha beta" if q else "broken", t) for q in (0, 1) for r, (i, t) in enumerate([(1, "gamma"), (2, "alpha"), (3, "alpha beta"), (4, "beta alpha")], 1)]
    return spark.createDataFrame(rows, "query_id int, id int, rank int, q string, t string").repartition(8)


def order(df):
    out = {}
    for r in df.orderBy("query_id", "new_rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_model_scores_and_failures(spark):
    # inside, so that workers get them with the function
    class Fails(retrieval.WordSets):
        def __call__(self, queries, texts):
            if "broken" in queries:
                raise RuntimeError("no")
            return retrieval.WordSets.__call__(self, queries, texts)

    def unloadable():
        raise OSError("no such model")

    assert order(retrieval.rerank(ranking(spark), "q", "t", 3, retrieval.model_scorer(retrieval.WordSets))) == {0: [1, 2, 3, 4], 1: [3, 2, 1, 4]}
    kept = order(retrieval.rerank(ranking(spark), "q", "t", 4, retrieval.model_scorer(Fails)))
    assert kept[0] == [1, 2, 3, 4]
    assert order(retrieval.rerank(ranking(spark), "q", "t", 4, retrieval.model_scorer(unloadable))) == {0: [1, 2, 3, 4], 1: [1, 2, 3, 4]}


def test_facets_are_one_scan(spark, sf):
    a = articles(spark, sf)
    plan = reports.facets(a, AS_OF, "arxiv", "cs.CV")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Expand" in plan  # documents and embeddings, each once


def test_golden_titles_without_all_pairs(spark, sf):
    assert "NestedLoop" not in registry.QUERIES["f9_match_golden"](spark, sf)._jdf.queryExecution().toString() and "Cartesian" not in registry.QUERIES["f9_match_golden"](spark, sf)._jdf.queryExecution().toString()
    rnd = random.Random(1)
    words = ["alpha", "betas", "gamma", "deltas", "of", "in", "networks", "a+b", "learning!"]
    titles = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 7)))) for i in range(150)]
    gold = [(i, None, t if i % 3 == 0 else t[:35] + " more" if i % 3 == 1 else " ".join(t.split()[::-1])) for i, (_, t) in enumerate(titles[:60])] + [(900, "7", "x"), (901, None, ""), (902, None, "ab"), (903, None, None)]
    got = {r["gold_id"]: (r["id"], r["stage"]) for r in X.match_golden(spark.createDataFrame(gold, "gold_id int, article_id string, title string"), spark.createDataFrame([*titles, (500, None)], "id long, title string")).collect()}

    def clean(t):
        import re

        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", t.lower())).strip()

    def naive(wanted, title):
        import re

        title = (title or "").strip()
        if wanted and any(str(i) == wanted for i, _ in titles):
            return int(wanted), "id"
        if not title:
            return None, "not found"
        same = [i for i, t in titles if t.lower() == title.lower()]
        if same:
            return min(same), "exact"
        holds = lambda t: clean(title) in clean(t) or clean(t) in clean(title)
        near = [i for i, t in titles if title[:30].lower() in t.lower() and holds(t)]
        if near:
            return min(near), "prefix"
        long = [w for w in re.findall(r"\w+", title.lower()) if len(w) > 4]
        some = [(i, t) for i, t in titles if long and all(w in t.lower() for w in long)][:5]
        some = [i for i, t in some if holds(t)]
        return (min(some), "words") if some else (None, "not found")

    assert got == {g: naive(w, t) for g, w, t in gold}
    assert {s for _, s in got.values()} >= {"id", "exact", "not found"}


def test_golden_titles_store_few_runs(spark, monkeypatch):
    """of the titles' letter runs only the rarest of each golden row are stored, and equal titles meet once."""
    stored = []

    def counted(df, cut=X.cut):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(X, "cut", counted)
    rnd = random.Random(2)
    words = ["gradient", "networks", "learning", "spectral", "attention", "transformers", "é\U0001f600tudes"]
    titles = [(i, " ".join(rnd.choices(words, k=60))) for i in range(40)] + [(100 + i, "Attention networks " + "learning " * 40) for i in range(100)]
    gold = [(i, None, titles[i][1] + " and more") for i in range(40)] + [(100 + i, None, "attention networks learning and morethan") for i in range(50)]
    got = {r["gold_id"]: (r["id"], r["stage"]) for r in X.match_golden(spark.createDataFrame(gold, "gold_id int, article_id string, title string"), spark.createDataFrame(titles, "id long, title string")).collect()}
    assert got == {i: (i, "prefix") for i in range(40)} | {100 + i: (None, "not found") for i in range(50)}
    assert max(stored) <= 1000, stored
