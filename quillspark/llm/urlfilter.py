"""Operator 3: URL filters from a path-template tree with labelled purity.

Rules judge what they fit.  All other URLs are judged by their template: every
host has a tree of path segments, whose variable segments become wildcards

* by their looks: runs of digits are ``{n}``, long hexadecimal names ``{h}``;
* by statistics, level by level from the root: the children of a node whose labelled
  share of blocked URLs isn't unlike that of the node's other children together merge
  into ``*``, and so do those without labels, about which nothing is known that would
  tell them apart.  A branch that has no labelled URL, or only one path, is done: the
  rest of its paths stands in the template as it looks.

Labels are the rules' own verdicts (or any label column).  A template is
rejected when its smoothed share of blocked URLs reaches ``purity``; shares are drawn
to the same template over all hosts, and that to the share over all URLs.

Statistics count distinct (host, path), so repeated URLs weigh once and a hot URL is
one row.  There is no greatest depth or number of children.

Defined cases: a null URL, or one without ``://``, has the empty host and path and
is judged like any other (no rule fits it unless one has an empty host); repeated
rows get equal verdicts; without labels all are allowed; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_table

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.  The list is given, and so bounded."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def looks(segment: Column) -> Column:
    return F.when(segment.rlike("^(?=.*[0-9])[0-9a-fA-F]{8,}$"), F.lit("{h}")).otherwise(F.regexp_replace(segment, "[0-9]+", "{n}"))


def template_tree(urls: DataFrame, z: float = 2.0) -> DataFrame:
    """(host, path, blocked) of distinct URLs, blocked null where unlabelled -> with look (by looks alone) and template added.

    Each round settles one branching of every path that isn't done yet: segments that all paths of a node share are passed
    over at once, and rows that are done are not written again.  So there are as many rounds as branchings on one path.
    """
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    rows = urls.withColumn("segs", F.transform(segments, looks)).withColumn("look", F.array_join("segs", "/"))
    rows = cut(rows.withColumn("template", F.lit("")).withColumn("pos", F.lit(0)), "url-tree")
    is_open, done = F.size("segs") > F.col("pos"), []
    while rows.filter(is_open).head(1):
        done.append(rows.filter(~is_open))
        here = rows.filter(is_open).withColumn("rest", F.slice("segs", F.col("pos") + 1, F.size("segs"))).withColumn("seg", F.element_at("rest", 1))
        child = here.groupBy("host", "template", "seg").agg(F.count("blocked").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("paths"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        node = child.groupBy("host", "template").agg(F.sum("n").alias("nn"), F.sum("b").alias("bb"), F.sum("paths").alias("all"), F.min("lo").alias("lo0"), F.max("hi").alias("hi0"))
        # what the least and the greatest rest begin with, all have
        same = F.transform("lo0", lambda s, i: F.get("hi0", i).eqNullSafe(s))
        node = node.withColumn("common", F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("lo0")).cast("int"))
        rest, rest_b = F.col("nn") - F.col("n"), F.col("bb") - F.col("b")
        share = (F.col("bb") + 1) / (F.col("nn") + 2)
        gap = (F.col("b") + share) / (F.col("n") + 1) - (rest_b + share) / (rest + 1)
        spread = F.sqrt(share * (1 - share) * (1 / (F.col("n") + 1) + 1 / (rest + 1)))
        differs = (F.col("n") > 0) & (F.abs(gap) >= z * spread)
        ends = (F.col("nn") == 0) | (F.col("all") == 1)
        child = child.join(node, ["host", "template"]).select("host", "template", "seg", ends.alias("ends"), (~ends & (F.col("common") == 0) & ~differs).alias("merged"), "common").filter("ends OR merged OR common > 1")
        child = cut(child, "url-merged")  # a table, so that the join can split the rows of a hot branch
        here = here.join(child, ["host", "template", "seg"], "left")
        over = F.coalesce("ends", F.lit(False))
        n = F.when(over, F.size("rest")).otherwise(F.greatest(F.lit(1), F.coalesce("common", F.lit(1))))
        step = F.when(~over & F.coalesce("merged", F.lit(False)), "*").otherwise(F.array_join(F.slice("rest", F.lit(1), n), "/"))
        here = here.withColumn("template", F.concat("template", F.lit("/"), step)).withColumn("pos", F.col("pos") + n)
        rows = cut(here.select(*rows.columns), "url-tree")
    for d in done:
        rows = rows.unionByName(d)
    return rows.drop("segs", "pos")


def template_purity(rows: DataFrame, weight: float = 4.0) -> DataFrame:
    """Adds the smoothed share of blocked URLs of each row's template."""
    b, n = F.coalesce(F.sum("blocked"), F.lit(0)), F.count("blocked")
    everywhere = rows.groupBy("look").agg(b.alias("lb"), n.alias("ln"))
    own = rows.groupBy("host", "template").agg(b.alias("tb"), n.alias("tn"))
    all_b, all_n = rows.agg(b, n).first()
    prior = F.lit(all_b / max(1, all_n))
    look = (F.col("lb") + weight * prior) / (F.col("ln") + weight)
    out = rows.join(everywhere, "look").join(own, ["host", "template"])
    return out.withColumn("purity", (F.col("tb") + weight * look) / (F.col("tn") + weight)).drop("lb", "ln", "tb", "tn")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, purity: float = 0.5, keep: list[str] | None = None, url_col: str = "url", prefix: str = "") -> DataFrame:
    """``keep`` columns (default: page_id) with host, path, rule, verdict, template and purity.

    prefix: stands before the names of added columns, where ``keep`` has such names.
    """
    keep = ["page_id"] if keep is None else keep
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = rows.select("host", "path").distinct().withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    urls = urls.select("host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("given"), (F.col("fit.verdict") == "block").cast("int").alias("blocked"))
    judged = template_purity(template_tree(urls))
    judged = judged.withColumn("verdict", F.coalesce("given", F.when(F.col("purity") >= purity, "block").otherwise("allow")))
    out = rows.join(judged, ["host", "path"])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in ("host", "path", "rule", "verdict", "template", "purity")])


def op3_url_templates(spark, sf_dir: str) -> DataFrame:
    return judge_urls(docs_table(spark, sf_dir, "pages"))
