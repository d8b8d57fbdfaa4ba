"""URL filters: explicit rules first, then a tree of path templates per host.

Null urls and urls without `://` have an empty host and path.  Each page is judged
by its url alone, so repeated rows get equal verdicts; an empty table gives an
empty result; extra columns stay, columns named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.text import ascii_lower, small
from listenlake.session import cut_lineage

# Host, path and verdict of each explicit rule.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Host labels that mark a page as unwanted when the templates are judged.
BLOCK_WORDS = ("casino", "bets", "pills", "spam", "adult", "porn")
#: Levels of the tree that may merge or generalise; the segments below stay one literal part of the template
#: (each generalised alone), so branches that differ deeper are still told apart, each by its own labels.
DEPTH = 6
#: A node with so many literal branches, met fewer than twice each on average, is a variable.
FANOUT = 50
#: Weight of the overall blocked share in a template's purity, and the purity that rejects.
SMOOTHING, PURITY = 2.0, 0.7


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null if none fits."""
    ordered = sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)
    found = None
    for name, start, verdict in ordered:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def general(segment: Column) -> Column:
    """A path segment with its variable part replaced by a placeholder."""
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.regexp_replace(segment, r"^[0-9]+", "{n}"))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
        .when(segment.rlike(r"^(?=.*[0-9]).{6,}$"), F.lit("{id}"))
        .otherwise(segment)
    )


def segments(path: Column, depth: int = DEPTH) -> Column:
    """Generalised segments of a path; those below `depth` joined by `/` as one last part."""
    parts = F.transform(F.array_remove(F.split(path, "/"), ""), general)
    deep = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(1))), "/")
    return F.when(F.size(parts) <= depth, parts).otherwise(F.concat(F.slice(parts, 1, depth), F.array(deep)))


def grow_tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Each (host, segs) leaf with its `template`: one level of the tree after the other.

    At a node the literal branches become one variable if there are many and each is rare.
    Otherwise branches are merged when they go on alike (the same kinds of next segment) and
    their labelled shares lie within two standard errors of the pool; a branch without labels
    stays by itself.  Only counts per branch are gathered, never its pages.
    """
    levels = leaves.agg(F.max(F.size("segs"))).first()[0] or 0
    tree = leaves.withColumn("template", F.lit(""))
    for level in range(levels):
        at, nxt = F.get("segs", F.lit(level)), F.get("segs", F.lit(level + 1))
        kind = F.when(nxt.isNull(), "end").when(nxt.startswith("{"), nxt).otherwise("word")
        here = tree.withColumn("seg", at)
        branch = here.filter("seg is not null").groupBy("host", "template", "seg").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"),
            F.array_sort(F.collect_set(kind)).alias("goes_on"),
        )
        literal = ~F.col("seg").startswith("{")
        node = branch.groupBy("host", "template").agg(
            F.sum(F.when(literal, 1).otherwise(0)).alias("literals"), F.sum(F.when(literal, F.col("n"))).alias("met"),
        ).filter((F.col("literals") >= fanout) & (F.col("met") < 2 * F.col("literals"))).select("host", "template", F.lit(True).alias("variable"))
        pool = branch.filter(literal & (F.col("labelled") > 0)).groupBy("host", "template", "goes_on").agg(
            F.count("*").alias("alike"), F.sum("labelled").alias("pool_n"), F.sum("blocked").alias("pool_blocked"), F.min("seg").alias("first"),
        )
        share, whole = F.col("blocked") / F.col("labelled"), F.col("pool_blocked") / F.col("pool_n")
        near = F.abs(share - whole) <= 2 * F.sqrt(whole * (1 - whole) / F.col("labelled"))
        named = branch.join(node, ["host", "template"], "left").join(pool, ["host", "template", "goes_on"], "left").select(
            "host", "template", "seg",
            F.when(literal & F.col("variable"), "*")
            .when(literal & (F.col("labelled") > 0) & (F.col("alike") > 1) & near, F.concat(F.lit("~"), "first"))
            .otherwise(F.col("seg")).alias("as_seg"),
        )
        tree = cut_lineage(here.join(named, ["host", "template", "seg"], "left").select(
            "host", "segs", "n", "labelled", "blocked",
            F.when(F.col("as_seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "as_seg")).alias("template"),
        ))
    return tree


def url_filter(pages: DataFrame, url: str = "url", rules=RULES, block_words=BLOCK_WORDS, labels: str | None = None) -> DataFrame:
    """`pages` with host, path, rule, template, purity and verdict.

    Labels for the templates come from the column `labels` of pages (1 unwanted, 0 wanted) where it
    has one, else from the rules and from hosts that carry a block word.  A template is rejected if
    its share of blocked labels, smoothed by the overall share, is at least PURITY: few labels keep
    it near the overall share; a template without any label is allowed.  Very long paths: segments below DEPTH form one part each page.
    """
    host, path = split_url(F.col(url))
    made = {"host", "path", "rule", "template", "purity", "verdict"}
    base = pages.drop(*[c for c in pages.columns if c.lower() in made and c not in (url, labels)]).withColumns({"host": host, "path": path})
    base = base.withColumn("_rule", match_rule(F.col("host"), F.col("path"), rules)).withColumn("_segs", segments(F.col("path")))
    named = reduce(lambda a, b: a | b, [F.col("host").contains(w) for w in block_words])
    label = F.when(named, 1).when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0)
    if labels is not None:
        label = F.coalesce(F.col(labels).cast("int"), label)
    leaves = cut_lineage(base.groupBy("host", F.col("_segs").alias("segs")).agg(
        F.count("*").alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked"),
    ))
    total = leaves.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = (total[0] or 0) / (total[1] or 1)
    tree = grow_tree(leaves)
    judged = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).select(
        "host", "template", ((F.col("blocked") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING)).alias("purity"),
        (F.col("labelled") > 0).alias("known"),
    )
    leaf = cut_lineage(tree.select("host", "segs", "template").join(judged, ["host", "template"]))
    # Without a single label a template gives no evidence: the prior alone would block all such when every label is a block.
    own = F.when(F.col("known") & (F.col("purity") >= PURITY), "block").otherwise("allow")
    return base.withColumnRenamed("_segs", "segs").join(small(leaf), ["host", "segs"], "left").withColumns({
        "rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), own),
    }).drop("_rule", "segs", "known")
