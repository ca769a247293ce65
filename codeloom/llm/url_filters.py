"""URL verdicts from rules and from a tree of path templates, with built-in functions only.

Every host has a tree of path segments. Level by level, variable segments become wildcards: by shape (numbers, hashes,
dates, long slugs), or because a node has many rare children. Literal sisters whose share of blocked pages does not
differ significantly are merged. A template is rejected if its smoothed share of blocked pages among labelled ones is high.
Labels come from the rules: a page that a block rule fits counts as blocked, one that an allow rule fits as allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# segments that vary by their shape
VARIABLE = r"^(?:\d[\d._-]*|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|.{40,})$"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, else null. The list is part of the plan, so it is meant for some hundred rules."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, rule.text).otherwise(found)
    return found


def segments(path: Column, depth: int) -> Column:
    """The path's segments with wildcards for variable ones; those below ``depth`` are one ``**``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(parts, lambda s: F.when(F.regexp_like(s, F.lit(VARIABLE)), F.lit("*"))
                         .when(F.regexp_like(s, F.lit(r"^\d+\.[A-Za-z0-9]{1,5}$")), F.concat(F.lit("*."), F.substring_index(s, ".", -1)))
                         .otherwise(s))
    return F.when(F.size(shaped) > depth, F.concat(F.slice(shaped, 1, depth), F.array(F.lit("**")))).otherwise(shaped)


def template_tree(leaves: DataFrame, *, depth: int = 4, max_children: int = 16, min_support: int = 8, z: float = 1.96) -> DataFrame:
    """(host, segs, template, n, n_block, n_labelled) of each different path shape of a host.

    ``leaves``: host, segs, n, n_block, n_allow. A node with more than ``max_children`` children folds those of fewer than
    ``min_support`` pages into a wildcard. Sisters of the same coarse block share are merged unless they differ from the
    pooled share by more than ``z`` standard errors; sisters without labels only merge with each other.
    """
    tree = leaves.withColumn("template", F.lit("")).withColumn("labelled", F.col("n_block") + F.col("n_allow"))
    node = ["host", "template"]
    for level in range(depth + 1):
        here = tree.withColumn("seg", F.get(F.col("segs"), F.lit(level)))
        children = here.filter(F.col("seg").isNotNull()).groupBy(*node, "seg").agg(
            F.sum("n").alias("n"), F.sum("n_block").alias("n_block"), F.sum("labelled").alias("labelled"))
        children = cut_lineage(children)
        nodes = children.groupBy(*node).agg(F.count("*").alias("n_children"))
        shown = children.join(nodes, node).withColumn("token", F.when(
            (F.col("n_children") > max_children) & (F.col("n") < min_support), F.lit("*")).otherwise(F.col("seg")))
        # sisters of a coarse share, then the test against their pooled share
        share = F.when(F.col("labelled") > 0, F.round(F.try_divide(4 * F.col("n_block"), F.col("labelled"))).cast("int")).otherwise(-1)
        shown = cut_lineage(shown.withColumn("share", share))
        literal = ~F.startswith(F.col("token"), F.lit("*"))
        pools = shown.filter(literal).groupBy(*node, "share").agg(
            F.count("*").alias("sisters"), F.min("seg").alias("first"), F.try_divide(F.sum("n_block"), F.sum("labelled")).alias("pooled"))
        judged = shown.join(pools, [*node, "share"], "left")
        spread = F.sqrt(F.greatest(F.col("pooled") * (1 - F.col("pooled")), F.lit(1e-6)) / F.greatest(F.col("labelled"), F.lit(1)))
        alike = (F.col("share") < 0) | (F.abs(F.try_divide(F.col("n_block"), F.col("labelled")) - F.col("pooled")) <= z * spread)
        token = F.when(literal & (F.col("sisters") > 1) & alike, F.concat(F.lit("{"), F.col("first"), F.lit("+}"))).otherwise(F.col("token"))
        names = cut_lineage(judged.select(*node, "seg", token.alias("token")))
        tree = cut_lineage(here.join(names, [*node, "seg"], "left").withColumn(
            "template", F.concat("template", F.when(F.col("token").isNotNull(), F.concat(F.lit("/"), F.col("token"))).otherwise("")))
            .drop("seg", "token"))
    sums = cut_lineage(tree.groupBy(*node).agg(F.sum("n").alias("n"), F.sum("n_block").alias("n_block"), F.sum("labelled").alias("n_labelled")))
    return tree.select("host", "segs", "template").join(sums, node)


def judge_urls(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", depth: int = 4, prior: float = 0.3,
               weight: float = 4.0, reject: float = 0.8, **tree_options) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for every row.

    A fitting rule decides; else the template is blocked if (blocked + weight * prior) / (labelled + weight) >= ``reject``,
    so a template without labels is allowed. Null urls and urls without ``://`` have an empty host and path. Repeated rows
    are judged alike; an empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.coalesce(F.col(url), F.lit(""))).alias("host"),
                        path_of(F.coalesce(F.col(url), F.lit(""))).alias("path"))
    rows = (rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
            .withColumn("segs", segments(F.col("path"), depth)))
    said = {r.text: r.verdict for r in rules}
    verdict = F.lit(None).cast("string")
    for text, v in said.items():
        verdict = F.when(F.col("rule") == text, v).otherwise(verdict)
    rows = cut_lineage(rows.withColumn("verdict", verdict))
    leaves = cut_lineage(rows.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("n_block"), F.count_if(F.col("verdict") == "allow").alias("n_allow")))
    judged = cut_lineage(template_tree(leaves, depth=depth, **tree_options)
                         .withColumn("purity", (F.col("n_block") + weight * prior) / (F.col("n_labelled") + weight))
                         .select("host", "segs", "template", "purity"))
    by_template = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.join(judged, ["host", "segs"]).select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", by_template).alias("verdict"), "template", "purity")
