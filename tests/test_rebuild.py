"""Incremental builds against full ones, cached grades, and rules that come from files."""

import os

import pytest
import yaml
from pyspark.sql import functions as F

from assayer.operators import grading as G
from assayer.operators import rebuild as B
from assayer.operators import ruleset as R
from assayer.plans import criteria as C
from tests.test_grading import card, rows

SCHEMA = "k long, v string, digest string, failed boolean"


def inputs(spark, values):
    return spark.createDataFrame([(k, v, None if v is None else f"d{v}", f) for k, v, f in values], SCHEMA)


def state(spark, path):
    return {r.k: (r.out, r.version) for r in spark.read.parquet(path).collect()}


def touched(path, since):
    return {d for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") and os.stat(f"{d}/{n}").st_mtime_ns > since}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "store")

    def compute(df):
        return df.select("k", F.concat(F.lit("<"), "v", F.lit(">")).alias("out"))

    def build(values, version="1", excluded=None):
        gone = None if excluded is None else spark.createDataFrame([(x,) for x in excluded], "k long")
        return B.rebuild(inputs(spark, values), path, compute, "k", version, gone, parts=50)

    base = [(i, f"a{i}", False) for i in range(1000)]
    assert build(base) == {"new": 1000, "changed": 0, "dropped": 0, "partitions": 50}
    assert build(base) == {"new": 0, "changed": 0, "dropped": 0, "partitions": 0}
    since = max(os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names)
    later = [(i, f"b{i}" if i in (3, 500, 7) else f"a{i}", False) for i in range(1000)]
    later[20] = (20, None, False)  # evicted: the stored record stays
    later[21] = (21, "c21", True)  # fetched again in vain: the old one stays
    later = [x for x in later if x[0] != 22] + [(2000, "n", False), (2001, None, False), (2002, "x", True)]  # one isn't told of at all
    got = build(later, excluded=[8, 9, 5000])
    assert got["new"] == 1 and got["changed"] == 3 and got["dropped"] == 2 and 1 <= got["partitions"] <= 6
    assert len({os.path.dirname(p) if p.endswith(".parquet") else p for p in touched(path, since)}) <= got["partitions"]
    want = {i: (f"<b{i}>" if i in (3, 500, 7) else f"<a{i}>", "1") for i in range(1000) if i not in (8, 9)} | {2000: ("<n>", "1")}
    assert state(spark, path) == want
    got = build(later, version="2", excluded=[8, 9])  # other rules: all with a usable input
    assert got["changed"] == 1000 - 2 - 3 + 1 and {v for _, v in state(spark, path).values()} == {"1", "2"}
    few = str(tmp_path / "few")
    B.rebuild(inputs(spark, [(1, "a", False)]), few, compute, "k", "1", parts=4)
    assert B.rebuild(inputs(spark, [(1, "a", False)]), few, compute, "k", "1", spark.createDataFrame([(1,)], "k long"), parts=4)["dropped"] == 1
    assert spark.read.schema("k long, out string").parquet(few).count() == 0
    assert B.rebuild(inputs(spark, []), str(tmp_path / "none"), compute, "k", "1")["partitions"] == 0


def test_cached_grades_equal_fresh_ones(spark, tmp_path):
    cards, defects = rows(spark, [card((55 + i % 30, 50, 75, 50), [("front", "corners", "corner_ding", "minor", True)] if i % 3 else []) for i in range(40)])
    grade = lambda d: G.report(d, defects).select("id", "psa_grade", "tag_score")
    content = ["front_lr", "front_tb", "back_lr", "back_tb"]
    path = str(tmp_path / "grades")
    want = lambda d: sorted(map(tuple, grade(d).collect()))
    assert sorted(map(tuple, B.regraded(cards, path, grade, "id", content, R.version(), 8).select("id", "psa_grade", "tag_score").collect())) == want(cards)
    moved = cards.withColumn("front_lr", F.when(F.col("id") == 5, 90.0).otherwise(F.col("front_lr"))).where("id <> 6")
    assert sorted(map(tuple, B.regraded(moved, path, grade, "id", content, R.version(), 8).select("id", "psa_grade", "tag_score").collect())) == want(moved)


def test_rules_from_files(spark, tmp_path):
    """All tables go to a file and come back; edited ones count at the next read, and the old ones return."""
    (tmp_path / "all.yaml").write_text(yaml.safe_dump(R.document(), sort_keys=False))
    tables = R.of_files(spark, str(tmp_path))
    assert {n: tables[n] for n in ("PSA", "DEFECTS", "CENTERING", "QUALIFIERS", "STACK_PENALTY")} == {n: R._frozen(getattr(C, n)) for n in ("PSA", "DEFECTS", "CENTERING", "QUALIFIERS", "STACK_PENALTY")} and len(tables) == len(R._TABLES)
    cards, defects = rows(spark, [card()])
    label = lambda: G.report(cards, defects).first().psa_label
    before, name = R.version(), label()
    (tmp_path / "all.yaml").unlink()
    (tmp_path / "psa.yaml").write_text(yaml.safe_dump({"psa": [[g, f"{t} edited"] for g, t in C.PSA]}))
    with R.in_force(R.of_files(spark, str(tmp_path))):
        assert label() == f"{name} edited" and R.version() != before
    assert label() == name and R.version() == before
    with pytest.raises(KeyError):
        with R.in_force({"nothing": 1}):
            pass
