"""URL filters by a tree of path templates per host, in DataFrame operations.

A path's segments are generalised: digits become `#`, and a segment too rare
below its parent becomes `*`.  That gives a tree of templates per host.  From
the host downwards, branches of a parent whose labelled purities are
statistically alike are merged to one cluster, and a cluster like its parent is
merged with it; one that differs has its own estimate, smoothed towards the
parent's.  Pages of a template whose
purity is below `least` are blocked.  Explicit rules come first.

Pages are aggregated to templates before anything is joined, so the tree has a
row per template.  The first `depth` levels are estimated for all pages; below
them a branch is divided as long as it has `support` pages, a label and paths
that differ, however deep they are.

Defined results: a null url or one without `://` has an empty host and path
and is judged like the other pages without a host; without labels every page
is allowed that no rule blocks; repeated rows and null ids keep their rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import spread_join, written

#: Verdict, host and path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bins of purity among the branches of a parent.
LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def located(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    rest = pages.select(F.col("page_id").cast("long").alias("page_id"), F.expr(
        "if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')").alias("rest"))
    rest = rest.select("page_id", F.coalesce("rest", F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return rest.select("page_id", F.translate(host, _UPPER, _LOWER).alias("host"),
                       F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(host, path, rules=RULES):
    """The longest fitting rule and its verdict (nulls without one)."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _shape(path):
    return F.regexp_replace(path, "[0-9]+", "#")


def template_purity(shapes: DataFrame, depth: int, support: int, weight: float, z: float) -> DataFrame:
    """host, shape, template and purity for each row (host, shape, n, labelled, good)."""
    total = shapes.agg(F.sum("labelled").alias("n"), F.sum("good").alias("good")).first()
    base = (total.good + 1.0) / (total.n + 1.0) if total.n else 1.0
    rows = shapes.withColumn("parts", F.split(F.regexp_replace("shape", "^/", ""), "/")).withColumn(
        "template", F.lit("")).withColumn("purity", F.lit(base))
    for level in range(depth + 1):
        rows = rows.withColumn("parent", F.col("template"))
        if level:
            part = F.expr(f"get(parts, {level - 1})")
            rows = rows.withColumn("part", F.coalesce(part, F.lit("")))
            seen = rows.groupBy("host", "template", "part").agg(F.sum("n").alias("here"))
            rows = spread_join(rows, seen, ["host", "template", "part"], "shape").withColumn(
                "part", F.when(F.col("here") < support, F.lit("*")).otherwise(F.col("part")))
            rows = rows.withColumn("template", F.when(F.size("parts") >= level, F.concat("template", F.lit("/"), "part"))
                                   .otherwise(F.col("template"))).drop("part", "here")
        tree = rows.groupBy("host", "parent", "template").agg(
            F.sum("labelled").alias("k"), F.sum("good").alias("g"), F.max("purity").alias("above"))
        now = _merged(written(tree, f"tree{level}"), weight, z)
        rows = spread_join(rows, now, ["host", "parent", "template"], "shape").withColumn("purity", F.col("now"))
        rows = written(rows.drop("now", "parent"), f"level{level}")
    out = ["host", "shape", "template", "purity"]
    ended = rows.where(F.size("parts") <= depth).select(*out)
    left = rows.where(F.size("parts") > depth).withColumn("rest", F.expr(f"slice(parts, {depth + 1}, size(parts))")).drop("parts")
    while not left.isEmpty():
        level += 1
        kin = left.groupBy("host", "template").agg(F.sum("n").alias("here"), F.sum("labelled").alias("known"),
                                                   F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        left = written(spread_join(left, kin, ["host", "template"], "shape"), f"kin{level}")
        parted = (F.col("here") >= support) & (F.col("known") > 0) & (F.col("lo") != F.col("hi"))
        ended = ended.unionByName(left.where(~parted).select(*out))
        # all paths of the branch begin as the least and the greatest do: that way has no estimates of its own
        left = left.where(parted).withColumn("common", F.expr(
            "int(array_position(zip_with(lo, hi, (a, b) -> coalesce(a = b, false)), false)) - 1"))
        left = left.withColumn("parent", F.expr("concat(template, array_join(transform(slice(rest, 1, common), x -> concat('/', x)), ''))"))
        left = left.withColumn("rest", F.expr("slice(rest, common + 1, size(rest))")).withColumn(
            "part", F.expr("get(rest, 0)")).drop("here", "known", "lo", "hi", "common", "template")
        seen = left.groupBy("host", "parent", "part").agg(F.sum("n").alias("here"))
        left = spread_join(left, seen, ["host", "parent", "part"], "shape").withColumn("template", F.when(
            F.col("part").isNull(), F.col("parent")).otherwise(F.concat("parent", F.lit("/"), F.when(
                F.col("here") < support, F.lit("*")).otherwise(F.col("part")))))
        left = left.withColumn("rest", F.expr("slice(rest, 2, size(rest))")).drop("part", "here")
        tree = left.groupBy("host", "parent", "template").agg(
            F.sum("labelled").alias("k"), F.sum("good").alias("g"), F.max("purity").alias("above"))
        now = _merged(written(tree, f"tree{level}"), weight, z)
        left = spread_join(left, now, ["host", "parent", "template"], "shape").withColumn("purity", F.col("now"))
        left = written(left.drop("now", "parent"), f"level{level}")
        ended = ended.unionByName(left.where(F.size("rest") == 0).select(*out))
        left = left.where(F.size("rest") > 0)
    return ended


def _merged(tree: DataFrame, weight: float, z: float) -> DataFrame:
    """host, parent, template and now: each branch's purity after merging.
    Branches of one parent are put into LEVELS bins of smoothed purity, and
    neighbouring bins whose rates don't differ by z standard errors become one
    cluster.  A cluster that differs from the parent by as much has an estimate
    of its own, smoothed towards the parent's; others take the parent's."""
    def own(k, g):
        return (F.col(g) + weight * F.col("above")) / (F.col(k) + weight)
    level = F.floor(own("k", "g") * LEVELS)
    tree = tree.withColumn("bin", F.when(F.col("k") > 0, level))
    bins = tree.where("k > 0").groupBy("host", "parent", "bin").agg(
        F.sum("k").alias("k"), F.sum("g").alias("g"), F.max("above").alias("above"))
    beside = Window.partitionBy("host", "parent").orderBy("bin")  # LEVELS + 1 rows at most
    bins = bins.withColumn("k0", F.lag("k").over(beside)).withColumn("g0", F.lag("g").over(beside))
    both = (F.col("g") + F.col("g0")) / (F.col("k") + F.col("k0"))
    error = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-4)) * (1 / F.col("k") + 1 / F.col("k0")))
    apart = F.abs(F.col("g") / F.col("k") - F.col("g0") / F.col("k0")) >= z * error
    bins = bins.withColumn("cluster", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(beside))
    pool = bins.groupBy("host", "parent", "cluster").agg(
        F.sum("k").alias("k"), F.sum("g").alias("g"), F.max("above").alias("above"))
    gap = F.abs(F.col("g") / F.col("k") - F.col("above")) / F.sqrt(
        F.greatest(F.col("above") * (1 - F.col("above")), F.lit(1e-4)) / F.col("k"))
    pool = pool.select("host", "parent", "cluster", F.when(gap < z, F.col("above")).otherwise(own("k", "g")).alias("now"))
    found = bins.join(pool, ["host", "parent", "cluster"]).select("host", "parent", "bin", "now")
    return tree.join(found, ["host", "parent", "bin"], "left").select(
        "host", "parent", "template", F.coalesce("now", "above").alias("now"))


def judge(pages: DataFrame, page_labels: DataFrame, rules=RULES, least: float = 0.5, depth: int = 4,
          support: int = 5, weight: float = 10.0, z: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity.  page_labels: page_id and good (boolean)."""
    page = located(pages).withColumn("shape", _shape(F.col("path")))
    label = page_labels.where("good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    known = page.join(label, "page_id", "left")
    shapes = written(known.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("good").alias("labelled"), F.count(F.when(F.col("good"), 1)).alias("good")), "shapes")
    tree = template_purity(shapes, depth, support, weight, z)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < least, F.lit("block")).otherwise(F.lit("allow"))
    return spread_join(page, tree, ["host", "shape"], "page_id").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")


def labels_by_url(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and good: the labels of the document whose id ends the page's path."""
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9/]*/?$", 1)
    linked = located(pages).select("page_id", F.when(number != "", number.cast("long")).alias("of")).where("of is not null")
    known = labels.where("quality is not null").select(
        F.col("doc_id").alias("of"), F.expr("quality = 1 and coalesce(toxic, 0) = 0").alias("good"))
    return linked.join(known, "of").select("page_id", "good")
