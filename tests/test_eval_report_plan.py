"""The report's scores are made once (A16), and benchmark items are found the same whatever is left out early (H1)."""

from litlens.plans import evaluate_queries as Q
from litlens.plans import registry, source_queries


def test_scores_are_made_once(spark, sf, monkeypatch):
    seen, real = [], source_queries.A.write_eval_report
    monkeypatch.setattr(source_queries.A, "write_eval_report", lambda *args: seen.extend(args) or real(*args))
    registry.QUERIES["a16_write_eval_report"](spark, sf)
    for df in seen[-2:]:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "benchmark" not in plan and "hits" not in plan


def test_items_are_found_with_any_number_of_first_words(spark, sf, monkeypatch):
    found = lambda: sorted((r[0], tuple(r[1])) for r in Q.golden(spark, sf).collect())
    want = found()
    docs = Q.table(spark, sf, "documents").collect()
    assert want and all(sorted(d["doc_id"] for d in docs if d["text"] and i["text"] in d["text"]) == list(dict(want).get(i["item_id"], ())) for i in Q.table(spark, sf, "benchmark").collect())
    monkeypatch.setattr(Q, "MOST_STARTS", 0)
    assert found() == want
