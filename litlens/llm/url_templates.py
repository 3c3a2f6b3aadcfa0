"""URL filter: host rules first, then a tree of path templates judged by smoothed labelled purity. DataFrame functions only.

A url that a rule fits is labelled by the rule. All urls, labelled or not, grow one tree per host: segments that look like
identifiers become `*`, and so do the children of a node with more than `max_children` different ones, level by level; what lies
below the first `max_levels` segments is one segment `**`. Every node counts the labelled and blocked urls below it. Labelled
sibling branches, in the order of their block rates, are merged where a two-sample test finds no difference between neighbours
(|z| < `z`). A template's purity is (blocked + strength * prior) / (labelled + strength) over its merged branches. Its prior is the
mean block rate of the same template on other domains, of which each counts once, smoothed in the same way by the rate of all
labelled urls. So a branch without labels is judged by what its template says elsewhere, never by its host or by other branches
of it; a template that no label reaches has no purity and is allowed. Templates of a purity of
`reject` or more are rejected; urls without a rule take their template's verdict. held_out() tells how often that errs.

Defined cases: a null url or one without `://` has empty host and path, fits no rule, and shares the template of the empty
path; repeated rows count as often as they occur; with no labelled url the prior is 0 and everything else is allowed; input
columns named host, path, rule, verdict, template, labelled or purity are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.llm.common import checkpoint, discard, read_table, union_all

#: (verdict, host, path): the production rules (fixed values of the query's contract).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment that is a number (with an extension or not), a date, a long hexadecimal string or a UUID.
IDENTIFIER = r"^(?:[0-9]+(?:[-_.][0-9]+)*|[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]{4,}){0,4})(\.[A-Za-z]{1,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def shape_of(path: Column, max_levels: int = 32) -> Column:
    """The path's segments, identifiers as `*`, and `**` for all behind max_levels of them."""
    some = F.filter(F.split(path, "/"), lambda s: s != "")
    first = F.transform(F.slice(some, 1, max_levels), lambda s: F.when(s.rlike(IDENTIFIER), "*").otherwise(s))
    return F.when(F.size(some) > max_levels, F.array_append(first, F.lit("**"))).otherwise(first)


def domain(host: Column) -> Column:
    """The last two labels of a host: hosts of one domain tend to fall under one rule."""
    return F.substring_index(host, ".", -2)


def templates(shapes: DataFrame, max_children: int) -> DataFrame:
    """shapes (host, _shape, ...) with template: level by level, the children of a node with too many of them become one."""
    deepest = shapes.agg(F.max(F.size("_shape"))).first()[0] or 0
    live = shapes.withColumn("template", F.expr("cast(array() as array<string>)"))
    ended = [live.filter("size(_shape) = 0")]
    for level in range(1, deepest + 1):
        live = live.filter(F.size("_shape") >= level).withColumn("_child", F.get(F.col("_shape"), F.lit(level - 1)))
        fan = live.select("host", "template", "_child").distinct().groupBy("host", "template").agg(F.count(F.lit(1)).alias("_fan"))
        grown = F.when(F.col("_fan") > max_children, F.lit("*")).otherwise(F.col("_child"))
        live = checkpoint(live.join(fan, ["host", "template"]).withColumn("template", F.concat("template", F.array(grown))).drop("_fan", "_child"))
        ended.append(live.filter(F.size("_shape") == level))
    return union_all(ended)


def purities(leaves: DataFrame, strength: float, z: float) -> DataFrame:
    """(host, template, labelled, purity) of leaves (host, template, labelled, blocked); labelled counts the merged branches."""
    upto = lambda n: F.slice(F.col("template"), F.lit(1), n)
    above = leaves.select("host", "template", "labelled", "blocked", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("depth")).withColumn("node", upto(F.col("depth")))
    nodes = above.groupBy("host", "depth", "node").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    # at most max_children siblings with labels stand beside each other
    known = checkpoint(nodes.filter("n > 0"))
    siblings = known.withColumn("parent", F.slice("node", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))).withColumn("rate", F.col("b") / F.col("n"))
    w = Window.partitionBy("host", "depth", "parent").orderBy("rate", "node")
    n0, b0 = F.lag("n").over(w), F.lag("b").over(w)
    pooled = (F.col("b") + b0) / (F.col("n") + n0)
    differs = F.pow(F.col("rate") - b0 / n0, 2) > z * z * pooled * (1 - pooled) * (1 / F.col("n") + 1 / n0)
    siblings = siblings.withColumn("differs", F.coalesce(differs, F.lit(False)).cast("int")).withColumn("run", F.sum("differs").over(w))
    run = Window.partitionBy("host", "depth", "parent", "run")
    merged = siblings.select("host", F.col("node").alias("template"), F.sum("n").over(run).alias("mn"), F.sum("b").over(run).alias("mb"))
    # the same template on other domains: each counts once, with its block rate
    by_domain = known.groupBy(domain(F.col("host")).alias("domain"), F.col("node").alias("template")).agg((F.sum("b") / F.sum("n")).alias("own_rate"))
    everywhere = by_domain.groupBy("template").agg(F.count(F.lit(1)).alias("domains"), F.sum("own_rate").alias("rates"))
    rate = leaves.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("rate"))
    out = leaves.select("host", "template").withColumn("domain", domain(F.col("host"))).join(merged, ["host", "template"], "left").join(everywhere, "template", "left").join(by_domain, ["domain", "template"], "left")
    others = F.coalesce("domains", F.lit(0)) - F.col("own_rate").isNotNull().cast("int")
    prior = (F.coalesce("rates", F.lit(0.0)) - F.coalesce("own_rate", F.lit(0.0)) + strength * F.col("rate")) / (others + strength)
    n, blocked = F.coalesce("mn", F.lit(0)), F.coalesce("mb", F.lit(0))
    return out.crossJoin(F.broadcast(rate)).select("host", "template", n.alias("labelled"), F.when(n + others > 0, (blocked + strength * prior) / (n + strength)).alias("purity"))  # one row


def judge(urls: DataFrame, url: str = "url", rules=RULES, max_children: int = 24, strength: float = 4.0, reject: float = 0.8, z: float = 1.96, max_levels: int = 32, hidden: Column | None = None) -> DataFrame:
    """urls with host, path, rule, verdict, template (array), labelled, purity. Where hidden is true, a rule labels nothing and the
    verdict is the template's."""
    host, path = split_url(F.col(url))
    others = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "template", "labelled", "purity")]
    rows = urls.select(F.struct(*others).alias("_row"), host.alias("host"), path.alias("path"), (F.lit(False) if hidden is None else F.coalesce(hidden, F.lit(False))).alias("_hidden"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "_said": F.when(~F.col("_hidden"), verdict), "_shape": shape_of(F.col("path"), max_levels)})
    # one row per host and shape from here on: a hot host is summed up before it is shuffled
    shapes = checkpoint(rows.groupBy("host", "_shape").agg(F.count("_said").alias("labelled"), F.count_if(F.col("_said") == "block").alias("blocked")))
    tree = checkpoint(templates(shapes, max_children))
    leaves = checkpoint(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
    judged = purities(leaves, strength, z)
    of_shape = checkpoint(tree.select("host", "_shape", "template").join(judged, ["host", "template"]))
    discard(shapes, tree, leaves)
    out = rows.join(of_shape, ["host", "_shape"], "left")
    said = F.coalesce(F.col("_said"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select(*[F.col("_row")[c].alias(c) for c in others], "host", "path", "rule", said.alias("verdict"), "template", "labelled", "purity")


def held_out(urls: DataFrame, url: str = "url", rules=RULES, folds: int = 5, **options) -> DataFrame:
    """(rule_says, template_says, urls): how the templates judge one of `folds` parts of the ruled urls, whose labels they do not
    see. The part is drawn by a hash of the url."""
    host, path = split_url(F.col("url"))
    rows = judge(urls.select(F.col(url).alias("url")), "url", rules, hidden=F.crc32(F.col("url")) % folds == 0, **options)
    ruled = rows.filter("rule IS NOT NULL").filter(F.crc32(F.col("url")) % folds == 0)
    return ruled.groupBy(rule_of(host, path, rules)[1].alias("rule_says"), F.col("verdict").alias("template_says")).agg(F.count(F.lit(1)).alias("urls"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "labelled", F.round("purity", 6).alias("purity"))
