import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayer.functions import reading as R
from assayer.functions import reports as P
from assayer.operators import checks as K


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x)


def test_measurements_and_verdict(spark):
    got = one(spark, *[K.measured_status(n, lit(v)) for n, v in (("sharpness", 0.1), ("sharpness", 0.15), ("sharpness", 0.2), ("resolution", 700.0), ("resolution", 400.0), ("resolution", 100.0), ("detection", None))])
    assert got == ["ok", "warn", "fail", "ok", "warn", "fail", "fail"]
    assert one(spark, K.verdict(lit("ok"), lit("warn")), K.verdict(lit("warn"), lit("fail")), K.verdict(lit("ok"))) == ["warn", "rescan", "ok"]


def test_sizes_and_axes(spark):
    assert one(spark, *[K.severity_from_size(lit(a), lit(b)) for a, b in ((15.0, 0.0), (0.0, 0.6), (1.5, 0.1), (0.1, 0.1))]) == ["major", "moderate", "minor", "micro"]
    a, b = one(spark, K.measured_axis(lit(3.0), lit(1.0), lit(0.5), lit(0.3)), K.measured_axis(lit(3.0), lit(1.0), lit(0.5), lit(0.2)))
    assert tuple(a) == (75.0, "measured") and tuple(b) == (50.0, "unread")
    assert one(spark, K.neutral_inset(lit(9.0), lit(0.1), lit(4.0), lit(0.9), lit(100.0)), K.neutral_inset(lit(9.0), lit(0.1), lit(4.0), lit(0.1), lit(100.0))) == [4.0, 5.0]


def test_levels(spark):
    ok, warn, fail, yes, no = map(lit, ("ok", "warn", "fail", True, False))
    assert one(spark, K.outline_level(ok, ok, ok, no), K.outline_level(ok, fail, ok, no), K.outline_level(ok, fail, ok, yes), K.outline_level(warn, ok, fail, no)) == [3, 0, 3, 1]
    axes = [(lit("measured"), lit(0.7), lit(0.4)), (lit("typed"), lit(0.1), lit(0.1))]
    assert one(spark, K.centering_level(no, axes), K.centering_level(yes, axes), K.centering_level(no, axes[1:])) == [2, 0, 0]
    assert one(spark, *[K.corners_edges_level(ok, ok, lit(n), no) for n in (0, 2, 7, 8)], K.corners_edges_level(ok, fail, lit(0), no), K.corners_edges_level(ok, ok, lit(0), yes)) == [3, 2, 1, 0, 0, 2]
    assert one(spark, K.surface_level(no, no, ok, ok, ok), K.surface_level(no, yes, warn, ok, ok), K.surface_level(yes, yes, ok, ok, ok)) == [1, 2, 0]
    whole, flat, lost, none = one(spark, *[K.overall(*map(lit, x)) for x in ((3, 3, 3, 3, False, False), (3, 3, 3, 1, True, False), (3, 3, 0, 3, False, True), (0, 3, 3, 3, False, False))])
    assert (whole.level, flat.level, lost.level, none.level) == (3, 2, 1, 0) and flat.rules == ["R_WEAKEST", "R_FLAT"] and lost.rules == ["R_WEAKEST", "R_CE_FAIL"] and none.rules == ["R_OUTLINE"]


def test_faces(spark):
    rows = [("a", "front", 3, "assessed"), ("a", "back", 1, "assessed"), ("b", "front", 2, "assessed"), ("b", "back", None, "not_scanned"), ("c", "front", None, "assessing")]
    got = {r.card: r for r in K.combined(spark.createDataFrame(rows, "card string, face string, level int, state string"), "card", "face", "level", "state").collect()}
    assert got["a"].level == 1 and got["b"].level == 2 and got["b"].missing == ["back"] and got["c"].level is None and got["c"].pending == ["front"]


def test_steps(spark):
    assert one(spark, K.scan_status([lit("ok"), lit("fail")], lit(0)), K.scan_status([lit("ok")], lit(9)), K.scan_status([lit("ok")], lit(8))) == ["fail", "warn", "pass"]
    d = lambda *x: F.array(*map(lit, map(float, x))) if x else F.array().cast("array<double>")
    assert one(spark, K.centering_status(d(1, -7), lit(False)), K.centering_status(d(4), lit(False)), K.centering_status(d(1), lit(True)), K.centering_status(d(1), lit(False)), K.centering_status(d(), lit(False))) == ["fail", "warn", "warn", "pass", None]
    assert one(spark, K.grade_status(lit(8.0), lit(9.0), lit(3)), K.grade_status(lit(9.0), lit(9.0), lit(0)), K.grade_status(lit(10.5), lit(9.0), lit(3)), K.grade_status(lit(10.0), lit(9.0), lit(3))) == ["fail", "warn", "warn", "pass"]
    assert one(spark, K.identify_status(lit(False), lit(True), lit(False)), K.run_status(F.array(lit("pass"), lit("warn")))) == ["warn", "warn"]


def test_reasons_places_and_lists(spark):
    blocked = F.create_map(lit("edges"), F.array(lit("glare")), lit("edges:top"), F.array(lit("glare"), lit("blur")), lit("surface"), F.array(lit("glare")))
    places = F.array(F.struct(lit("top_left").alias("place"), lit(False).alias("ok"), lit("glare").alias("reason")))
    edges = F.array(F.struct(lit("top").alias("place"), lit(True).alias("ok"), lit("x").alias("reason")))
    got = one(spark, K.limit_reasons(blocked, "edges", lit(True)), K.limit_reasons(blocked, "surface", lit(False)), K.unassessed_places(edges, places))
    assert got == [["glare", "blur"], ["not seen under angled light", "glare"], {"top-left corner": "glare"}]
    defects = F.array(*[F.struct(lit(t).alias("type"), lit(p).alias("location")) for t, p in (("scratch", "surface"), ("scratch", "top"), ("odd", "top"))])
    assert one(spark, K.defect_list_errors(defects, {"scratch": ("surface",)}, K.location_component)) == [["defect #2: location not allowed", "defect #3: unknown type"]]


def test_pending_flags(spark):
    s = "card int, side string, location string, type string, severity string"
    flags = spark.createDataFrame([(1, "front", "top", "dent", "minor"), (1, "front", "left", "dent", "minor"), (1, "back", "top", "dent", "major")], s)
    added = spark.createDataFrame([(1, "front", "top", "dent", "major")], s)
    dismissed = spark.createDataFrame([(1, "front", "left", "dent", "major"), (1, "back", "top", "dent", "major")], s)
    assert [(r.location, r.confirmed) for r in K.pending_flags(flags, added, dismissed, "card").collect()] == [("left", False)]


def read(spark, function, *rows):
    """``function`` of text columns a, b, ... for each row; structs as tuples."""
    width = max(len(r) for r in rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, " + ", ".join(f"{c} string" for c in "abcdefghi"[:width]))
    return [tuple(r.x) if r.x is not None else None for r in df.select("place", function(*[F.col(c) for c in "abcdefghi"[:width]]).alias("x")).orderBy("place").collect()]


def test_numbers(spark):
    cases = {
        ("2/102 ★", "pokemon"): ("2/102", "", ""), ("C 062/054 sR", "pokemon"): ("062/054", "", ""), ("i Q) £\\ SV55/5V94 eis", "pokemon"): ("SV55/SV94", "", ""),
        ("G OBF EN 125/197", "pokemon"): ("125/197", "OBF", "EN"), ("RC5/RC25", "pokemon"): ("RC5/RC25", "", ""), ("113/1O5", "pokemon"): ("113/105", "", ""),
        ("VEN + SP3/006 + EN", "riftbound"): ("SP3/006", "VEN", "EN"), ("OGN • 001/298", "riftbound"): ("001/298", "OGN", ""), ("SWSH050", "pokemon"): ("SWSH050", "", ""),
        ("OBF EN l25/I97", "pokemon"): ("125/197", "OBF", "EN"), ("x TG05/TG30 y", "pokemon"): ("TG05/TG30", "", ""), ("5/10\nABC EN 6/10", "pokemon"): ("6/10", "ABC", "EN"),
        ("SWSH O50", "pokemon"): ("SWSH050", "", ""), ("1|5/197 JA", "pokemon"): ("5/197", "", "JP"), ("3/10 4/10 KO", "pokemon"): ("3/10", "", "KO"),
    }
    got = read(spark, R.read_number, *cases)
    for (case, want), r in zip(cases.items(), got, strict=True):
        assert r[:3] == want, case
    assert [r[3] for r in got].count("promo") == 2
    assert read(spark, lambda c: R.read_number(c), *[(t,) for t in ("998.99", "MEFREAK. 9 *x", "©1995-2000 Nintendo", "", "LV. 45 #249", "999/12", "0/100", None)]) == [None] * 8
    assert read(spark, R.number_parts, (" sp3 / 006",), (None,), ("12/034/5",)) == [("SP3", "006", None, 6), ("", "", None, None), ("12", "034", 12, 34)]


def test_names(spark):
    got = read(spark, R.read_name, ("Suicune ex A",), ("Shining Raichu",), ("Charizard DELTA SPECIES",), ("STAGE 1 Ninetales",), ("Dark Blastoise",), ("l ucia C",), ("",), (None,), ("STAGE 2 Charizard ex HP 330",), ("of the Ruler of the Black Flame\nMew",))
    assert got == [("Suicune ex A", "Suicune"), ("Shining Raichu", "Shining"), ("Charizard DELTA SPECIES", "Charizard"), ("Ninetales", "Ninetales"), ("Dark Blastoise", "Blastoise"), None, None, None, ("Charizard ex", "Charizard"), ("Black Flame", "Black")]


def test_collector_lines(spark):
    got = read(spark, R.collector_line, ("VEN · SP3/006 · EN",), ("OGN-001/298 EN",), ("SV3 223/197 ja",), ("en de 25",), ("VEN-12a",), (None,))
    assert got == [("SP3/006", "VEN", "EN"), ("001/298", "OGN", "EN"), ("223/197", "SV3", "JP"), ("25", "DE", "EN"), ("12A", "VEN", None), (None, None, None)]


def test_model_readings_and_queries(spark):
    answer = lambda *c: R.model_reading(F.struct(*[x.alias(n) for x, n in zip(c, "game name printed_name set_name set_code number language variant confidence".split())]))
    got = read(spark, answer, ("pokemon", "Sabrina's Gengar", "ゲンガー", "Gym", "g2", " 14 / 132", "Japanese", None, "1.4"), ("other", None, None, None, "too long", "a b c d e f g h i j", "xx", "v\x01w", "nan"))
    assert got[0] == (True, "pokemon", "Sabrina's Gengar", "ゲンガー", "Gengar", "14/132", "G2", "Gym", "JP", "", 1.0)
    assert got[1] == (False, "", "", "", "", "", "", "", "", "v w", 0.0) or got[1][5] == "" and got[1][10] == 0.0
    query = lambda *c: F.struct(R.lookup_queries(F.struct(*[x.alias(n) for x, n in zip(c, "name name_key printed_name number set_code language".split())])))
    rows = read(spark, query, ("A B", "A", "ニャッス", "1/2", "OBF", "JP"), ("", "", "", "", "", ""), ("Mew", "Mew", "", "", "", "EN"))
    assert [tuple(q) for q in rows[0][0]] == [("OBF", "", "ニャッス", "JP"), ("OBF", "", "ニヤツス", "JP"), ("OBF", "1/2", "A", "JP"), ("", "1/2", "A", "JP"), ("", "", "A B", "JP"), ("", "", "A B", "EN"), ("", "", "A", "JP")]
    assert rows[1][0] == [] and [tuple(q) for q in rows[2][0]] == [("", "", "Mew", "EN")]
    assert len({r for r in read(spark, lambda *c: F.struct(R.lookup_key(*c)), ("Pokemon", " OBF", "1", "Mew", None), ("pokemon", "obf", "1 ", "mew", ""))}) == 1


def test_report(spark):
    text = "x\nEN\nCharizard\n1999 #4/102\nBase\nHolo\n945\nTAG SCORE\n9\nMINT\nCORNERS\nF:\n2 DINGS\nB:\n0 DINGS\nCENTERING\nF:\n55L/45R 50T/50B\nB:\n50L/50R 50T/50B\nSnapshot Of Defects\nBack / TOP RIGHT\nCORNER WEAR\nVIEW\nFront\nCentering\n56L/44R 48T/52B\nDINGS MAP\nGRADED 2026-01-02"
    texts = [text, "A\nVIEW SCORE\n8.5\nNM", None, "", "TAG SCORE", "EN\nTAG SCORE", "a\n\u3000VIEW SCORE\u00a0\nTAG SCORE\nx", "Snapshot Of Defects\nFront / EDGE\nBack", "Snapshot Of Defects\nfront\nCENTERING", "SURFACE\nB:", "Snapshot Of Defects\nBack / A / B\nSURFACE / WRINKLE\nFronted\nx", "y\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("lines", P.lines_of(F.col("text")))
    got = [r.r.asDict(True) for r in df.select("i", P.report_record(F.col("lines")).alias("r")).orderBy("i").collect()]
    r = got[0]
    assert (r["score"], r["card_name"], r["year_line"], r["set_line"], r["variant"], r["grade"], r["grade_label"]) == (945, "Charizard", "1999 #4/102", "Base", "Holo", 9.0, "MINT")
    assert r["dings"]["corners"] == {"front": 2, "back": 0} and r["surface"] is None and r["dings"]["surface"] == {"front": None, "back": None} and r["graded_on"] == "2026-01-02"
    assert r["ding_list"] == [{"side": "back", "location": "topright", "type": "corner wear"}, {"side": "front", "location": "card", "type": "centering 56L/44R 48T/52B"}]
    assert (got[1]["grade"], got[1]["card_name"], got[1]["score"]) == (8.5, "A", None) and got[2]["grade"] is None and got[3]["card_name"] == got[4]["card_name"] == got[5]["card_name"] == ""
    assert (got[6]["card_name"], got[6]["grade"], got[6]["grade_label"]) == ("a", None, "") and got[7]["ding_list"] == []
    assert got[8]["ding_list"] == [{"side": "front", "location": "card", "type": "centering "}] and got[9]["surface"] == {"front": None, "back": None}
    assert got[10]["ding_list"] == [{"side": "back", "location": "a", "type": "surface / wrinkle"}]


def test_report_records_equal_the_expression_and_search_the_heading_once(spark):
    rng = random.Random(11)
    some = ["EN", "TAG SCORE", "VIEW SCORE", "945", "8.5", "x", "CORNERS", "EDGES", "SURFACE", "F:", "B:", "2 DINGS", "1 DING", "VIEW", "GRADED 2026-01-02", "", " \u2003"]
    listed = ["Front", "Back / TOP LEFT", "front / a / b", "Fronted", "CENTERING", "Centering", "56L/44R", "CORNER  WEAR", "VIEW", "BACK /\tA B\u00a0", "back\r"]
    text = lambda: "\n".join(rng.choices(some, k=rng.randrange(14)) + ["Snapshot Of Defects (all)"] * rng.randrange(2) + rng.choices(listed, k=rng.randrange(9)))
    texts = [text() for _ in range(400)] + ["".join(f"{chr(c)}{c:x}{chr(c)}\n" for c in range(1, 0x3100) if c != 10), " " * 200000 + "a" + " " * 200000 + "b"]

    def plain(lines):
        """The list by a loop, a line at a time."""
        at = [i for i, x in enumerate(lines) if x.startswith("Snapshot Of Defects")]
        rest, out = [x for x in lines[at[0] + 1 :] if x != "VIEW"] if at else [], []
        placed = lambda x: re.match(r"(?i)(front|back)\b", x, re.ASCII)
        while len(rest) > 1 and placed(rest[0]):
            parts, kind = [p.strip(" ") for p in rest[0].split("/")], rest[1].lower()
            if len(parts) == 1 and kind == "centering":
                out.append((parts[0].lower(), "card", "centering " + "".join(rest[2:3])))
                rest = rest[3:]
            elif placed(rest[1]):
                break
            else:
                out.append((parts[0].lower(), re.sub(r"\s+", "", "".join(parts[1:2]).lower(), flags=re.ASCII), kind))
                rest = rest[2:]
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", P.lines_of(F.col("text")).alias("lines"))
    records = P.report_records(df, F.col("lines"))
    assert records.columns == ["i", "text", "lines", "record"]
    got, want = records.orderBy("i").collect(), df.select("i", P.report_record(F.col("lines")).alias("record")).orderBy("i").collect()
    assert [r.record for r in got] == [r.record for r in want]
    white = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    for r in got:
        assert r.lines == [x for x in (x.strip(white) for x in r.text.split("\n")) if x]
        assert [tuple(d) for d in r.record.ding_list] == plain(r.lines), r.text
    assert sum(len(r.record.ding_list) for r in got) > 40
    # the heading's search for a language, in one step (dozens of times when each line of the heading searched anew)
    plan = entry.queries()["q_report_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", EN)") + plan.count(" = EN)") <= 4 and plan.count("TAG SCORE)") <= 2, (plan.count("EN)"), plan.count("TAG SCORE)"))
