"""Card identification, explanations and the record build: every query against its SQL, and odd rows."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import cards as K
from assayer.operators import pricing as P
from assayer.operators import records as B
from assayer.plans import cards
from tests.tests_support import check


@pytest.mark.parametrize("name", list(cards.ORACLE_SQL))
def test_oracles(spark, name):
    check(spark, name, "sf0.001")


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_identification(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(spark, K.set_guesses(lit("SV3.5")), K.set_guesses(lit(" me1 ")), K.set_guesses(none)) == [["SV3.5", "sv3.5", "sv03.5"], ["me1", "me01"], [""]]
    got = one(spark, K.rift_parts(lit("ogn-066a-298")), K.rift_number(lit("ven-sp3-006")), K.rift_number(none), K.rift_number_matches(lit("ogn-066a-298"), lit("66/298")), K.rift_number_matches(lit("ven-sp3-006"), lit("SP3/006")), K.rift_number_matches(lit("ven-sp3-006"), lit("3")))
    assert tuple(got[0]) == ("ogn", "066a", "298") and got[1:] == ["SP3/006", "", True, True, False]
    assert one(spark, K.rift_variant(none.cast("boolean"), lit(True), lit(True)), K.year_prefix(lit("1999/01/09")), K.year_prefix(lit("0000")), K.year_prefix(none)) == ["Alternate Art", 1999, None, None]
    flags = F.struct(*[lit(k in ("reverse", "holo")).alias(k) for k in K.VARIANTS])
    card = F.struct(lit("base1-4").alias("id"), lit("4").alias("localId"), lit("Charizard").alias("name"), none.alias("rarity"), lit("http://i").alias("image"), flags.alias("variants"), lit("Base").alias("set"), lit("1999-01-09").alias("release"))
    assert tuple(one(spark, K.catalog_candidate(card))[0]) == ("Charizard", "4", "", "Reverse holo / Holo", "Base", 1999, "http://i/high.png", "http://i/low.webp", True, "base1-4")
    assert one(spark, K.key_kind(lit("a" * 40)), K.key_kind(lit("z" * 25)), K.key_kind(lit("x")), K.name_matches(none, F.array(lit("a"))), K.name_matches(lit("Ｐｉｋａ"), F.array(lit(""), lit("pikachu"))), K.number_matches(lit("025/1"), none)) == [["prices", "model", "catalog"], ["catalog"], [], False, True, None]
    size = lambda n: lit(n).cast("bigint")
    assert one(spark, K.reference_problem(lit("image/gif"), size(3), none), K.reference_problem(lit("image/PNG"), size(0), none), K.reference_problem(lit("image/png"), size(2**26), none), K.reference_problem(lit("image/png"), size(9), none), K.reference_problem(none, none.cast("bigint"), lit("data:image/png;base64,xx")), K.reference_problem(none, none.cast("bigint"), none)) == ["type", "empty", "too large", None, None, "missing"]


def test_saved_cards(spark):
    d = F.from_json(F.lit('[{"type":"a"},{"type":"b","confirmed":false},{"type":"c","confirmed":true}]'), "array<struct<type:string,confirmed:boolean>>")
    none = F.lit(None).cast("array<struct<type:string,confirmed:boolean>>")
    assert one(spark, F.transform(K.legacy_defects(d), lambda x: x["type"]), K.legacy_defects(none)) == [["a", "c"], []]
    assert tuple(one(spark, K.legacy_evidence(F.create_map(F.lit("front_lr"), F.lit("unread"))))[0]) == ("unread", "typed", "typed", "typed")


def test_answers_and_options(spark):
    body = '{"candidates":[{"content":{"parts":[{"text":"a"},{},{"text":"b"}]},"finishReason":"STOP","groundingMetadata":{"groundingChunks":[{"web":{"uri":"u","title":"t"}},{}],"webSearchQueries":["q"]}}]}'
    got = one(spark, P.response_fields(F.lit(body)), P.response_fields(F.lit("{}")), B.json_or_text(F.lit("[1]")), B.json_or_text(F.lit('a"b')))
    assert tuple(got[0]) == ("ab", ["u"], ["q"], True, "STOP") and tuple(got[1]) == ("", [], [], False, "") and got[2:] == ["[1]", '"a\\"b"']


def test_fetch_of_a_record(spark):
    text = '{"source":{"report_url":"r","fetched_at":"f","agent":"a"},"report_txt_sha256":"t","images":{"front":{"url":"u","sha256":"s","bytes":3},"back":{"url":"v"}}}'
    schema = "struct<source:struct<report_url:string,fetched_at:string,agent:string>,report_txt_sha256:string,images:map<string,struct<url:string,sha256:string,bytes:bigint>>>"
    r = one(spark, B.fetch_of_record(F.from_json(F.lit(text), schema)))[0]
    assert (r.source_url, r.fetched_at, r.agent, r.report_txt_sha256) == ("r", "f", "a", "t") and set(r["images"]) == {"front"} and tuple(r["images"]["front"]) == ("u", "s", 3)
