import pytest
from pyspark.sql import functions as F

from assayer.functions import text as X


@pytest.mark.parametrize("raw,key", [("001/298", "1/298"), ("sp3/006", "SP3/6"), ("021a/166", "21A/166")])
def test_number_keys(spark, raw, key):
    assert spark.range(1).select(X.number_key(F.lit(raw))).first()[0] == key


def test_centering_text(spark):
    got = spark.createDataFrame([("57L/43R 54T/46B",), ("57L/43R",), (None,)], "t string").select(X.centering_shares(F.col("t")).alias("c")).collect()
    assert (got[0].c.lr, got[0].c.tb) == (57, 54) and got[1].c is None and got[2].c is None


def test_same_number(spark):
    df = spark.createDataFrame([("025", "25", True), ("SP3", "sp3", True), ("25", "26", False), ("a1", "1", False)], "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", X.same_number(F.col("a"), F.col("b")).alias("got")).collect())


def test_normal_forms():
    assert X.upper_key_text(" Ｐｏｋé  ｍon ") == "POKÉ MON"
    assert X.plain_text("Pokémon—VMAX!") == "pokemon vmax"
    assert X.loose_text("Farfetch’d (EX)") == "farfetch'd ex"
    assert X.plain_text(None) == ""


def test_vectorised(spark):
    df = spark.createDataFrame([("É x",), (None,)], "t string")
    assert [r[0] for r in df.select(X.vectorised(X.plain_text, "string")("t")).collect()] == ["e x", ""]


def test_json_in_text():
    assert X.json_in_text('so: ```json\n{"a": {"b": 1}}``` {') == '{"a":{"b":1}}'
    assert X.json_in_text("{no}") is None and X.json_in_text(None) is None


def test_jpeg_size():
    frame = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x02\x58\x03\x20\x03" + b"\0" * 12
    assert X.jpeg_size(frame) == (800, 600)
    assert X.jpeg_size(b"\x89PNG") is None and X.jpeg_size(frame[:10]) is None and X.jpeg_size(None) is None


def test_python_round():
    assert X.python_round(2.675, 2) == 2.67 and X.python_round(None, 2) is None


def test_sites(spark):
    df = spark.createDataFrame([("a.com", "a.com", True), ("x.a.com", "a.com", True), ("xa.com", "a.com", False)], "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", X.same_site(F.col("a"), F.col("b")).alias("got")).collect())


def test_normal_forms_as_columns_equal_the_functions(spark):
    texts = ["", None, "  a\tB  c\n", "ﬁ Ａ", "Pokémon’s  Ñ", "x_y-z'", "\x1ca\x1fb", "ß straße", "日本 語", "A1/B2", "é́"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.upper_key(F.col("t")).alias("u"), X.loose(F.col("t")).alias("l"), X.plain_any(F.col("t")).alias("p")).orderBy("i")
    for r, t in zip(df.collect(), texts, strict=True):
        assert (r.u, r.l, r.p) == (X.upper_key_text(t), X.loose_text(t), X.plain_text(t))
    keys = spark.createDataFrame([(" mew  ex", "Bäse", "1"), ("MEW EX", "Bäse", "1")], "a string, b string, c string").select(X.card_key(F.col("a"), F.col("b"), F.col("c")).alias("k")).collect()
    assert keys[0].k == keys[1].k == "MEW EX|BÄSE|1"
