"""URL filters: rules by host and path, and for what no rule decides a tree of path templates per host.

What a rule decides is the labelled part. Per host the paths become templates, one segment after the other: a segment of
digits or a long hexadecimal one is a wildcard of its kind, and so is any segment that fewer than ``support`` pages have
at its place in the tree; an extension stays. Then branches of one node that differ in a single literal and agree in
everything below are merged where their labels agree: branches with the same prevailing label (blocked, allowed, none)
are pooled, and a branch joins its pool if a chi-square test (two degrees of freedom, 5 %) finds no difference between
it and the others there. A template is rejected if the share of allowed among its labelled pages, smoothed by
``weight`` pages of the share ``prior``, is under ``purity``; its pages without a rule are blocked, all others allowed.

Everything is SQL. Pages are counted into distinct (host, shape) first, with map-side combining, so a large host is never
in one task; the tree is built on these counts, and pages meet their shape's verdict in a join whose large partitions can
be split. Segments beyond ``levels`` are one: their number bounds the rounds.

Defined results: a null url, or one without "://", has an empty host and path and no rule; repeated rows are judged and
counted each; page_id is passed on, null too; long urls are read whole; an empty table gives an empty one; extra columns
are not read. Of rules of one length the first in alphabetical order wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import apart, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Wildcards of segments; "<*>" is any rare one, "<+>" merged branches, "<**>" all beyond the last level.
DIGITS, HEX, RARE, MERGED, BEYOND = "<n>", "<x>", "<*>", "<+>", "<**>"
CHI_SQUARE = 5.991


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def by_length(rules: Iterable[str]) -> list[str]:
    return sorted(set(rules), key=lambda r: (-len(r), r))


def rule_of(host: Column, path: Column, rules: Iterable[str]) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for r in by_length(rules):
        own, _, rest = r.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        out = F.when(fits, r) if out is None else out.when(fits, r)
    return F.lit(None).cast("string") if out is None else out


def shape(path: Column, levels: int) -> Column:
    """The path with wildcards for digits and long hexadecimal segments; segments beyond ``levels`` are one."""
    segments = F.split(F.regexp_replace(F.replace(path, F.lit("<"), F.lit("%3C")), "^/", ""), "/", -1)
    end = r"(\.[a-z]{1,5})?$"

    def of(s: Column) -> Column:
        digits = F.regexp_replace(s, f"^[0-9]+{end}", f"{DIGITS}$1")
        return F.when(s.rlike(f"^[0-9a-f-]{{16,}}{end}") & s.rlike("[0-9]") & s.rlike("[a-f]"), F.regexp_replace(s, f"^[0-9a-f-]+{end}", f"{HEX}$1")).otherwise(digits)

    cut = F.when(F.size(segments) > levels, F.concat(F.slice(segments, 1, levels), F.array(F.lit(BEYOND)))).otherwise(segments)
    return F.array_join(F.transform(cut, of), "/")


def _literal(segment: Column) -> Column:
    return (segment != "") & ~segment.startswith("<")


def generalised(counts: DataFrame, levels: int, support: int) -> DataFrame:
    """``counts`` (host, shape, n, block, allow) with ``template``: segments of fewer than ``support`` pages at their place
    of the tree are wildcards too."""
    tree = written(counts.withColumn("template", F.lit("")), "tree")
    for level in range(levels + 1):
        tree = tree.withColumn("s", F.get(F.split("shape", "/", -1), F.lit(level)))
        many = tree.where(_literal(F.col("s"))).groupBy("host", "template", "s").agg(F.sum("n").alias("pages")).where(F.col("pages") >= support)
        both = tree.join(many.select(*apart("host", "template", "s"), "pages"), ["host", "template", "s"], "left")
        rare = _literal(F.col("s")) & F.col("pages").isNull()
        own = F.when(rare, F.concat(F.lit(RARE), F.regexp_extract("s", r"\.[a-z]{1,5}$", 0))).otherwise(F.col("s"))
        step = F.when(F.col("s").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), own))
        tree = written(both.select("host", "shape", "n", "block", "allow", step.alias("template")), "tree")
    return tree


def difference(own: list[Column], pool: list[Column]) -> Column:
    """Chi-square of a branch's counts against those of the rest of its pool, in doubles; null without a rest."""
    own, pool = [c.cast("double") for c in own], [c.cast("double") for c in pool]
    rest = [p - o for o, p in zip(own, pool, strict=True)]
    n, m = own[0] + own[1] + own[2], rest[0] + rest[1] + rest[2]
    terms = [F.when(p > 0, (o * m - r * n) * (o * m - r * n) / (n * m * p)).otherwise(0.0) for o, r, p in zip(own, rest, pool, strict=True)]
    return F.when(m > 0, terms[0] + terms[1] + terms[2])


def merged(tree: DataFrame, levels: int, most: float = CHI_SQUARE) -> DataFrame:
    """``tree`` with similar branches under one template."""
    sums = [F.sum(c).alias(c) for c in ("n", "block", "allow")]
    for level in range(levels):
        branches = tree.groupBy("host", "template").agg(*sums).withColumn("s", F.get(F.split("template", "/", -1), F.lit(level + 1))).where(_literal(F.col("s")))
        place = F.split("template", "/", -1)
        general = F.array_join(F.concat(F.slice(place, 1, level + 1), F.array(F.lit(MERGED)), F.slice(place, level + 3, levels + 3)), "/")
        none = F.col("n") - F.col("block") - F.col("allow")
        label = F.when((F.col("block") >= F.col("allow")) & (F.col("block") >= none), "block").when(F.col("allow") >= none, "allow").otherwise("none")
        branches = written(branches.select("host", "template", general.alias("general"), label.alias("label"), "block", "allow", none.alias("none")), "branches")
        pools = branches.groupBy("host", "general", "label").agg(*[F.sum(c).alias(f"all_{c}") for c in ("block", "allow", "none")])
        tested = branches.join(pools.select(*apart("host", "general", "label"), "all_block", "all_allow", "all_none"), ["host", "general", "label"])
        same = difference([F.col(c) for c in ("block", "allow", "none")], [F.col(f"all_{c}") for c in ("block", "allow", "none")]) <= most
        moved = tested.where(same).select(*apart("host", "template"), "general")
        tree = tree.join(moved, ["host", "template"], "left").select("host", "shape", "n", "block", "allow", F.coalesce("general", "template").alias("template"))
        tree = written(tree, "tree")
    return tree


def rejected(tree: DataFrame, prior: float, weight: float, purity: float) -> DataFrame:
    """host and shape of rejected templates."""
    share = (F.sum("allow") + F.lit(prior * weight)) / (F.sum("allow") + F.sum("block") + F.lit(weight))
    bad = tree.groupBy("host", "template").agg(share.alias("share")).where(F.col("share") < purity)
    return tree.join(bad.select(*apart("host", "template")), ["host", "template"], "left_semi").select("host", "shape")


def judged(pages: DataFrame, rules: dict[str, str], page: str = "page_id", url: str = "url", levels: int = 4, support: int = 20, prior: float = 0.5, weight: float = 10.0, purity: float = 0.25) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and template_rejected. ``rules`` maps host/path to a verdict."""
    host, path = parts(F.col("url"))
    own = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    of_rule = lambda v: F.coalesce(F.col("rule").isin([r for r in rules if rules[r] == v]), F.lit(False))
    keyed = own.withColumn("shape", shape(F.col("path"), levels))
    counts = keyed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(of_rule("block")).alias("block"), F.count_if(of_rule("allow")).alias("allow"))
    bad = rejected(merged(generalised(counts, levels, support), levels), prior, weight, purity)
    out = keyed.join(bad.select(*apart("host", "shape"), F.lit(True).alias("bad")), ["host", "shape"], "left").withColumn("template_rejected", F.coalesce("bad", F.lit(False)))
    verdict = F.when(of_rule("block"), "block").when(of_rule("allow"), "allow").when(F.col("template_rejected"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template_rejected")
