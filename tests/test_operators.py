"""Literal cases of single operators."""

from pyspark.sql import functions as F

from litlens.functions import text as T
from litlens.functions import vectors as V
from litlens.operators import evaluate, hygiene, ingest, matching, search, topics


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_light_clean(spark):
    assert one(spark, T.light_clean(F.lit("A &amp; B $$x$$ \\emph{word}  \n end"))) == "A & B x word end"
    assert one(spark, T.light_clean(F.lit(None).cast("string"))) == ""


def test_title_key_keeps_letters(spark):
    assert one(spark, T.title_key(F.lit("Déjà-vu: A  Study!"))) == "déjàvu a study"


def test_split_list(spark):
    assert one(spark, T.split_list(F.lit(" cs.CL, ,cs.AI "))) == ["cs.CL", "cs.AI"]


def test_cosine_zero_and_null(spark):
    a, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.cosine(a, z)) == 0.0
    assert one(spark, V.cosine(a, F.lit(None).cast("array<double>"), default=0.5)) == 0.5


def test_reassign_outliers(spark):
    v = [([1.0, 0.0], 0), ([0.9, 0.1], 0), ([0.0, 1.0], 1), ([0.1, 0.9], 1), ([0.95, 0.05], -1), ([-1.0, -1.0], -1)]
    df = spark.createDataFrame([(i, x, c) for i, (x, c) in enumerate(v)], "id long, embedding array<float>, cluster_id int")
    got = {r["id"]: r["new_cluster_id"] for r in topics.reassign_outliers(df, 0.9).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: -1}
    assert topics.reassignment_counts(topics.reassign_outliers(df, 0.9)).first()["reassigned"] == 1


def test_score_retrieval(spark):
    golden = spark.createDataFrame([(1, [1, 2])], "question_id int, expected array<long>")
    ranked = spark.createDataFrame([(1, 3, 1), (1, 1, 2), (1, 1, 3), (1, 2, 4)], "question_id int, id long, rank int")
    r = evaluate.score_retrieval(golden, ranked, 3).first()
    assert (r["recall_at_k"], round(r["precision_at_k"], 4), r["mrr"]) == (1.0, 0.6667, 0.5)


def test_optimal_mapping_beats_greedy(spark):
    table = spark.createDataFrame([(0, 0, 9), (0, 1, 8), (1, 0, 8), (1, 1, 1)], "label int, cluster_id int, n long")
    got = {(r["label"], r["cluster_id"]) for r in matching.optimal_mapping(table).collect()}
    assert got == {(0, 1), (1, 0)}


def test_dedupe_last_keeps_first_place(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq int, k string")
    assert sorted((r["seq"], r["k"], r["_position"]) for r in ingest.dedupe_last(df, "k", "seq").collect()) == [(2, "b", 2), (3, "a", 1)]


def test_dedupe_ids_empty_keys_pass(spark):
    df = spark.createDataFrame([(1, None, "d"), (2, "", "D"), (3, None, "d")], "id int, arxiv_id string, doi string").withColumn("paper_id", F.lit(None).cast("string"))
    kept, dups = hygiene.dedupe_ids(df)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2]
    assert [r["duplicate_reason"] for r in dups.collect()] == ["duplicate_doi"]


def test_parse_date(spark):
    assert str(one(spark, ingest.parse_date(F.lit("Mon, 1 Jan 2024 12:00:00 GMT")))) == "2024-01-01 12:00:00"
    assert one(spark, ingest.parse_date(F.lit("soon"))) is None


def test_query_terms(spark):
    assert one(spark, search.query_terms(F.lit("the MACE papers about Sürü-zekası AI"))) == ["mace", "suru-zekasi", "ai"]


def test_rrf_marks_both(spark):
    v = spark.createDataFrame([(1, "k1", 10, 0.9, 2)], "query_id int, key string, id long, score double, rank int")
    b = spark.createDataFrame([(1, "k1", 10, 3.0, 1), (1, "k2", 11, 2.0, 2)], v.schema)
    got = search.fuse_rrf(search.merge_candidates(v, b)).orderBy("fusion_rank").collect()
    assert [(r["key"], r["retrieval_source"]) for r in got] == [("k1", "both"), ("k2", "bm25")]


def test_native_operators_have_no_python_node(spark, sf):
    from litlens.plans import registry

    for name in ("c18_clean_papers", "i9_rising_topics", "g9_bm25_search"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "ArrowEval" not in plan


def test_approximate_search_recall(spark, sf):
    from litlens.plans import registry

    near, exact = ({(r["query_id"], r["id"]) for r in registry.QUERIES[q](spark, sf).collect()} for q in ("g5_vector_search_lsh", "g4_vector_search"))
    assert len(near & exact) >= 0.9 * len(exact)


def test_reader_errors(spark, tmp_path):
    import pytest

    from litlens.sources import files

    (tmp_path / "golden.json").write_text('[{"question_id": "a", "question": "b", "expected_article_ids": []}]')
    with pytest.raises(Exception, match="expected ids"):
        files.read_golden(spark, str(tmp_path / "golden.json")).collect()
    (tmp_path / "assigned.csv").write_text("article_id,other\n1,2\n")
    with pytest.raises(ValueError, match="topic"):
        files.read_assignments(spark, str(tmp_path / "assigned.csv"))
