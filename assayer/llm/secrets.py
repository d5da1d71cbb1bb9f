"""Secret scanning with corpus-wide ownership frequency.

Three base patterns (``assign``, ``access``, ``hex``) are found in every text. Beside them the scan notes ``wide``
candidates: token-like strings of mixed classes and high entropy that no base pattern covers. The digest of every
candidate's secret value is counted over the corpus by distinct repositories (``repository`` column, the document unless
the table names one) and distinct owners (``owner`` column, the source). A value that several owners hold is an example
copied from place to place; one that stays with few owners looks live, however often they copied it. Verdicts go back to
the documents: base spans always stay, live wide spans are added, widely copied wide ones are not.

Counts are two-level aggregations with map-side combining, so one value held by a third of all rows reaches a task as
one row per map task; verdicts meet the spans in an equi-join whose large partitions can be split.

Defined results: null text is empty; a text is scanned whole, whatever its length; a null repository or owner counts as
one of its own; repeated rows are each returned, and count once; an empty table gives an empty one; ties between spans
that start together go by kind; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import apart, written

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WIDE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}")
DIGIT, SMALL, LARGE = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
KINDS = ("assign", "access", "hex", "wide")


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's place in KINDS, secret value) of the base patterns, by start, then kind."""
    out = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def wide_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Candidates that overlap no base span. ``reach[i]`` is the furthest end of the first i base spans."""
    starts, reach = [s[0] for s in base], [0]
    for s in base:
        reach.append(max(reach[-1], s[1]))
    out = []
    for m in WIDE.finditer(text):
        s = m[0]
        if DIGIT.search(s) and SMALL.search(s) and LARGE.search(s) and entropy(s) >= 3.5 and reach[bisect_right(starts, m.end() - 1)] <= m.start():
            out.append((m.start(), m.end(), 3, s))
    return out


def spans_with_digests(t: str | None) -> list[tuple[int, int, int, str]]:
    base = base_spans(t := t or "")
    return [(a, b, k, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()) for a, b, k, v in sorted(base + wide_spans(t, base))]


def scan(docs: DataFrame, text: str = "text", doc: str = "doc_id", owner: str = "source", repository: str | None = None, owners_of_example: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, owner, spans (start, stop, kind, value's sha256, repositories and owners that
    hold it, verdict ``live`` / ``example``). ``wide`` spans are kept only if live. The scan's result, without texts, is
    written once and read twice."""

    @F.pandas_udf("array<struct<start:int,stop:int,kind:int,value:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([spans_with_digests(t) for t in texts], dtype=object)

    names = [F.col(doc).alias("doc_id"), F.col(owner).alias("owner"), F.col(repository or doc).cast("string").alias("repository")]
    seen = written(docs.select(*names, found(F.col(text)).alias("found")).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = seen.select("row", "owner", "repository", F.posexplode("found").alias("at", "span"))
    # null-safe: struct keys keep a null repository or owner apart from all others
    held = each.select(F.col("span.value").alias("value"), F.struct("owner").alias("o"), F.struct("repository").alias("r")).distinct()
    by_owner = held.groupBy("value", "o").agg(F.count(F.lit(1)).alias("n"))
    owners = by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    repositories = held.select("value", "r").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repositories"))
    verdict = owners.join(repositories, "value").select(*apart("value"), "owners", "repositories")
    word = F.when(F.col("owners") >= owners_of_example, "example").otherwise("live")
    told = each.select("row", "at", "span", F.col("span.value").alias("value")).join(verdict, "value").select("row", "at", "span", "repositories", "owners", word.alias("verdict"))
    told = told.where((F.col("span.kind") < 3) | (F.col("verdict") == "live"))
    spans = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), F.col("span.kind").alias("kind"), F.col("span.value").alias("value"), "repositories", "owners", "verdict"))).alias("spans"))
    out = F.coalesce(F.transform("spans", lambda x: x.dropFields("at")), F.array().cast("array<struct<start:int,stop:int,kind:int,value:string,repositories:bigint,owners:bigint,verdict:string>>"))
    return seen.select("row", "doc_id", "owner").join(spans, "row", "left").select("doc_id", "owner", out.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s result."""
    kind = F.array(*map(F.lit, KINDS))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(test):
        return F.size(F.filter("spans", test)).cast("long")

    return scanned.select(
        "doc_id",
        count(lambda x: x["kind"] == 0).alias("n_assign"),
        count(lambda x: x["kind"] == 1).alias("n_access"),
        count(lambda x: x["kind"] == 2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        count(lambda x: x["verdict"] == "live").alias("n_live"),
        count(lambda x: x["verdict"] == "example").alias("n_example"),
    )
