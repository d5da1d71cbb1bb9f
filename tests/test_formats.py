"""Rule files, landed pages, and sinks whose failing tasks leave the old state."""

import json
import os

import pytest
from pyspark.sql import functions as F

from assayer.sources import files as S
from assayer.sources import formats as X


def test_rule_files_are_read_anew(spark, tmp_path):
    (tmp_path / "psa.yaml").write_text("floor: 1.5\nlabels:\n  - {grade: 10, name: GEM}\n  - {grade: 9, name: 'MINT é'}\npoints: {9: 1, 9.5: 2}\n")
    (tmp_path / "tag.json").write_text('{"bands":[[990,"x"]]}')
    (tmp_path / "notes.txt").write_text("floor: 3")
    (tmp_path / "empty.yml").write_text("")
    df = X.register(spark).read.format("rule_files").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 3 and sorted((r.document, r.name, r.pos) for r in df.collect()) == [("psa", "floor", 0), ("psa", "labels", 0), ("psa", "labels", 1), ("psa", "points", 0), ("tag", "bands", 0)]
    rules = X.rules_of(spark, str(tmp_path))
    assert rules["psa"]["labels"] == [{"grade": 10, "name": "GEM"}, {"grade": 9, "name": "MINT é"}] and rules["psa"]["floor"] == [1.5] and rules["tag"]["bands"] == [[990, "x"]]
    (tmp_path / "psa.yaml").write_text("floor: 2.5\n")
    assert X.rules_of(spark, str(tmp_path))["psa"] == {"floor": [2.5]}


def test_landed_pages(spark, tmp_path):
    for n in range(1, 13):
        items = [{"id": f"{n}-{i}", "n": i, "price": 1 if i else 1.5, "tags": ["a", i], "page": 9, "set": None if n == 1 else "x"} for i in range(3)]
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"items": items, "pages": 11, "total": 33}))
    df = X.register(spark).read.format("landed_pages").option("path", str(tmp_path)).load()
    rows = df.orderBy("page", "pos").collect()
    assert [r.id for r in rows] == [f"{n}-{i}" for n in range(1, 9) for i in range(3)] and df.rdd.getNumPartitions() == 8
    assert dict(df.dtypes)["price"] == "double" and rows[1].price == 1.0 and rows[4].tags == '["a",1]' and rows[5].n == 2
    few = spark.read.format("landed_pages").option("path", str(tmp_path)).option("limit", 2).load()
    assert few.count() == 6
    (tmp_path / "none").mkdir()
    assert spark.read.format("landed_pages").option("path", str(tmp_path / "none")).load().count() == 0


def fails(c):
    return F.when(F.col(c) == 17, F.raise_error(F.lit("a task fails")).cast("string")).otherwise(F.col(c).cast("string"))


def test_export_of_one_document(spark, tmp_path):
    path = str(tmp_path / "backup.json")
    cards = spark.range(40).select("id", F.concat(F.lit("né\n"), F.col("id")).alias("name")).repartition(4)
    X.export_document(cards, "id", path, "app", 3, "2026-01-01T00:00:00Z")
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    assert (got["app"], got["version"], got["exported_at"]) == ("app", 3, "2026-01-01T00:00:00Z") and got["cards"] == [{"id": i, "name": f"né\n{i}"} for i in range(40)]
    assert S.backup(spark, path, "id bigint, name string").count() == 40
    before = open(path, "rb").read()
    with pytest.raises(Exception, match="a task fails"):
        X.export_document(cards.withColumn("name", fails("id")), "id", path, "app", 3, "x")
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["backup.json"]
    X.export_document(cards.limit(0), "id", path, "app", 3, "x")
    with open(path) as f:
        assert json.load(f)["cards"] == []


def test_insert_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.range(40).select("id", F.lit("a").alias("kind")).repartition(4)
    read = lambda: spark.read.schema("id bigint, kind string").json(f"{path}/*")
    X.insert(rows, path)
    X.insert(rows.where("id < 3").withColumn("id", F.col("id") + 100), path)
    assert read().count() == 43
    with pytest.raises(Exception, match="a task fails"):
        X.insert(rows.withColumn("kind", fails("id")), path)
    assert read().count() == 43 and os.listdir(tmp_path) == ["records"]
