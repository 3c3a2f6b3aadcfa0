"""Clustering, retrieval and answer evaluation (F, H), in closed forms that need no pair join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlens.functions import vectors as V


def cluster_coverage(df: DataFrame) -> DataFrame:
    """counts and ratios; label -1 is an outlier, null is not clustered."""
    has, lab = F.col("embedding").isNotNull(), F.col("cluster_id")
    n, emb, out = F.count(F.lit(1)), F.count_if(has), F.count_if(lab == -1)
    clustered = F.count_if(lab >= 0)
    rate = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return df.agg(n.alias("articles"), emb.alias("embedded"), clustered.alias("clustered"), out.alias("outliers"), F.count_distinct(F.when(lab >= 0, lab)).alias("clusters"), rate(clustered, emb).alias("coverage"), rate(out, clustered + out).alias("outlier_ratio"))


def unit_rows(df: DataFrame) -> DataFrame:
    return df.filter((F.col("cluster_id") >= 0) & F.col("embedding").isNotNull()).select("id", "cluster_id", V.l2_normalize(F.col("embedding")).alias("v"))


def vector_sums(rows: DataFrame) -> DataFrame:
    """(cluster_id, s, n, q): sum of vectors, rows and sum of squared norms per cluster; partial sums before the shuffle."""
    parts = rows.select("cluster_id", F.posexplode("v").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return parts.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("s"), F.max("n").alias("n"), F.sum("q").alias("q"))


def silhouette(df: DataFrame) -> DataFrame:
    """mean cosine silhouette in linear time: distances to a cluster average to 1 - x . sum / n. The cluster sums are
    one row a cluster and travel as one array."""
    rows = unit_rows(df)
    sums = vector_sums(rows).agg(F.collect_list(F.struct("cluster_id", "s", "n")).alias("sums"))
    j = rows.crossJoin(F.broadcast(sums))  # one row
    own = F.filter("sums", lambda c: c["cluster_id"] == F.col("cluster_id"))[0]
    others = F.filter("sums", lambda c: c["cluster_id"] != F.col("cluster_id"))
    j = j.withColumn("own", own)
    a = F.when(F.col("own")["n"] > 1, (F.col("own")["n"] - V.dot(F.col("v"), F.col("own")["s"])) / F.greatest(F.col("own")["n"] - 1, F.lit(1)))
    b = F.array_min(F.transform(others, lambda c: 1 - V.dot(F.col("v"), c["s"]) / c["n"]))
    scored = j.withColumns({"a": a, "b": b}).select(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    return scored.agg(F.avg("s").alias("silhouette"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """Euclidean, on unit vectors."""
    rows = unit_rows(df)
    c = vector_sums(rows).select("cluster_id", F.expr("transform(s, x -> x / n)").alias("c"))
    dist = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z))
    spread = rows.join(c, "cluster_id").groupBy("cluster_id").agg(F.avg(dist(F.col("v"), F.col("c"))).alias("d"))
    k = c.join(spread, "cluster_id")
    x, y = k.select(F.col("cluster_id").alias("i"), F.col("c").alias("ci"), F.col("d").alias("di")), k.select(F.col("cluster_id").alias("j"), F.col("c").alias("cj"), F.col("d").alias("dj"))
    ratio = (F.col("di") + F.col("dj")) / dist(F.col("ci"), F.col("cj"))
    return x.join(y, F.col("i") != F.col("j")).groupBy("i").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))  # clusters are few


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """from cluster sums alone: between = sum |s|^2 / n - |S|^2 / N, within = Q - sum |s|^2 / n."""
    sums = vector_sums(unit_rows(df))
    flat = sums.select("n", "q", "cluster_id", F.posexplode("s").alias("pos", "x"))
    per = sums.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("k"), F.sum(V.dot(F.col("s"), F.col("s")) / F.col("n")).alias("p"))
    whole = flat.groupBy("pos").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("t"))
    j = per.crossJoin(whole)  # one row each
    between, within = F.col("p") - F.col("t") / F.col("n"), F.col("q") - F.col("p")
    return j.select((between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def intra_cosine(df: DataFrame, limit: int = 500) -> DataFrame:
    """mean pair cosine of the first rows of each cluster: (|sum|^2 - sum |x|^2) / 2 instead of the pairs."""
    rows = unit_rows(df).withColumn("_rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))).filter(F.col("_rn") <= limit)
    s = vector_sums(rows)
    return s.agg((F.sum((V.dot(F.col("s"), F.col("s")) - F.col("q")) / 2) / F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("intra_cosine"))


def centroid_similarity(df: DataFrame) -> DataFrame:
    """x . s / |s| summed is |s|, so cluster sums are enough."""
    return vector_sums(unit_rows(df)).agg((F.sum(V.norm(F.col("s"))) / F.sum("n")).alias("centroid_similarity"))


def size_stats(df: DataFrame) -> DataFrame:
    """F7"""
    n = df.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.median("n").alias("median_size"), (F.max("n") / F.sum("n")).alias("largest_ratio"))


def evaluation_status(df: DataFrame) -> DataFrame:
    """F8: why a clustering can't be scored, or ok."""
    c = cluster_coverage(df)
    return c.select(F.when(F.col("embedded") == 0, "no_embeddings").when(F.col("clustered") == 0, "no_clustered_rows").when(F.col("clusters") < 2, "fewer_than_two_clusters").otherwise("ok").alias("status"), (F.col("clustered") > F.col("clusters")).alias("scorable"))


def contingency(df: DataFrame, a: str = "label", b: str = "cluster_id") -> DataFrame:
    """F11"""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def purity_mapping(table: DataFrame, label: str = "label", cluster: str = "cluster_id") -> DataFrame:
    """each cluster's most common label; ties go to the first label."""
    w = Window.partitionBy(cluster).orderBy(F.desc("n"), label)
    return table.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def purity(table: DataFrame) -> DataFrame:
    return purity_mapping(table).agg(F.sum("n").alias("hit")).crossJoin(table.agg(F.sum("n").alias("total"))).select((F.col("hit") / F.col("total")).alias("purity"))  # one row each


def adjusted_rand(table: DataFrame, a: str = "label", b: str = "cluster_id") -> DataFrame:
    """F14"""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    rows = table.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("x"))
    cols = table.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("y"))
    both = table.agg(pairs("n").alias("ij"), F.sum("n").alias("t")).withColumn("all", F.col("t") * (F.col("t") - 1) / 2)
    j = both.crossJoin(rows).crossJoin(cols).withColumn("e", F.col("x") * F.col("y") / F.col("all"))  # one row each
    return j.select(((F.col("ij") - F.col("e")) / ((F.col("x") + F.col("y")) / 2 - F.col("e"))).alias("adjusted_rand"))


def nmi(table: DataFrame, a: str = "label", b: str = "cluster_id") -> DataFrame:
    """normalised by the mean entropy."""
    t = table.crossJoin(F.broadcast(table.agg(F.sum("n").alias("t")))).withColumn("x", F.sum("n").over(Window.partitionBy(a))).withColumn("y", F.sum("n").over(Window.partitionBy(b)))  # one row
    mi = t.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("x") * F.col("y")))).alias("mi"))
    h = lambda c, name: t.select(c, "t", "x" if c == a else "y").distinct().agg(F.sum(-F.col("x" if c == a else "y") / F.col("t") * F.log(F.col("x" if c == a else "y") / F.col("t"))).alias(name))
    return mi.crossJoin(h(a, "hx")).crossJoin(h(b, "hy")).select((2 * F.col("mi") / (F.col("hx") + F.col("hy"))).alias("nmi"))  # one row each


def score_retrieval(golden: DataFrame, ranked: DataFrame, k: int | str) -> DataFrame:
    """H1: hit, recall, precision, MRR and nDCG at k, a number or golden's column of it. golden: (question_id, expected array);
    ranked: (question_id, id, rank), where only an id's best rank counts."""
    best = ranked.groupBy("question_id", "id").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy("question_id").orderBy("_r", "id")
    top = best.withColumn("pos", F.row_number().over(w))
    rel = golden.select("question_id", (F.col(k) if isinstance(k, str) else F.lit(k)).alias("_k"), F.explode(F.array_distinct("expected")).alias("id")).join(top, ["question_id", "id"], "left")
    rel = rel.withColumn("pos", F.when(F.col("pos") <= F.col("_k"), F.col("pos")))
    g = rel.groupBy("question_id", "_k").agg(F.count(F.lit(1)).alias("m"), F.count("pos").alias("hits"), F.min("pos").alias("first"), F.coalesce(F.sum(1 / F.log2(F.col("pos") + 1)), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("m", "_k").cast("int")), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1))
    return g.select("question_id", (F.col("hits") > 0).alias("hit_at_k"), (F.col("hits") / F.col("m")).alias("recall_at_k"), (F.col("hits") / F.col("_k")).alias("precision_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg_at_k"))


def summarize_retrieval(scores: DataFrame) -> DataFrame:
    """H3: means over questions, zeros for none."""
    m = lambda c, name: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(name)
    return scores.agg(F.count(F.lit(1)).alias("question_count"), m("hit_at_k", "hit_rate_at_k"), m("recall_at_k", "mean_recall_at_k"), m("precision_at_k", "mean_precision_at_k"), m("mrr", "mean_mrr"), m("ndcg_at_k", "mean_ndcg_at_k"))


def retrieval_signals(results: DataFrame) -> DataFrame:
    """H4"""
    n = F.count(F.lit(1))
    return results.groupBy("question_id").agg((1 - F.count_distinct("id") / n).alias("duplicate_rate"), *[F.count_if(F.col("retrieval_source") == s).alias(f"n_{s}") for s in ("vector", "bm25", "both")])


def answer_signals(text: Column) -> dict[str, Column]:
    """H5: citation marks and a sources section."""
    t = F.coalesce(text, F.lit(""))
    return {"citation_marker_count": F.regexp_count(t, F.lit(r"\[S\d+\]")), "has_sources_section": t.rlike(r"(?i)(^|\n)\s*(?:#+\s*)?(?:Sources|Kaynaklar)\b\s*:?")}


#: Phrases of an answer that says that it lacks evidence.
INSUFFICIENT = r"not contain enough evidence|yeterli kanıt|yeterli evidence|does not contain enough"


def score_answers(df: DataFrame, answer: str, title: str, key_terms: str, evidence: str) -> DataFrame:
    """H6: df with title_mentioned, term_recall, evidence_recall, citation_marker_count, has_sources_section, insufficient_evidence
    and answer_chars, of columns answer, title, key_terms (array) and evidence (text)."""
    plain = lambda c: F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\p{Z}]+", " "))
    rows = df.withColumns({"_a": plain(F.col(answer)), "_k": F.coalesce(F.col(key_terms), F.expr("cast(array() as array<string>)")), "_e": important_terms(F.col(evidence))})
    share = lambda terms, clean: F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.col("_a").contains(clean(t)))) / F.size(terms)).otherwise(0.0)
    text = F.coalesce(F.col(answer), F.lit(""))
    out = {"title_mentioned": F.col("_a").contains(plain(F.col(title))), "term_recall": share("_k", plain), "evidence_recall": share("_e", lambda t: t), **answer_signals(F.col(answer)), "insufficient_evidence": text.rlike(f"(?i){INSUFFICIENT}"), "answer_chars": F.length(text)}
    return rows.withColumns(out).drop("_a", "_k", "_e")


#: Words that are no key terms, and the form of a key term.
NO_TERMS = ("the", "and", "with", "that", "this", "from", "into", "uses", "use", "for", "through", "both", "real")
TERM = r"[a-zA-Z][a-zA-Z0-9-]{4,}"


def important_terms(text: Column, stop: tuple[str, ...] = NO_TERMS) -> Column:
    """H7: distinct terms of five characters or more, the first twenty."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*stop))), 1, 20)
