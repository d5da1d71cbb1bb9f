"""Text normalisers and parsers. Column functions where SQL functions can say it; vectorised Python where Unicode
normal forms or free-form parsing are needed."""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- Unicode forms


def upper_key_text(s: str | None) -> str:
    """NFKC, white space collapsed, upper case."""
    return " ".join(unicodedata.normalize("NFKC", s or "").split()).upper()


def loose_text(s: str | None) -> str:
    """NFKC, lower case, straight apostrophes, other non-word characters to spaces."""
    return " ".join(re.sub(r"[^\w']+", " ", unicodedata.normalize("NFKC", s or "").lower().replace("’", "'")).split())


def plain_text(s: str | None) -> str:
    """NFKD without diacritics, lower case, everything but a-z and 0-9 to single spaces."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", (s or "").lower()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", bare).strip()


def vectorised(function, kind: str):
    """A pandas UDF of a function of one value."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return run


def of_any(c: Column, sql, python) -> Column:
    """``sql`` of ASCII text; only other text is sent to Python. Null is empty."""
    text = F.coalesce(c, F.lit(""))
    ascii_ = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, sql(text)).otherwise(vectorised(python, "string")(F.when(~ascii_, text)))


def upper_key(c: Column) -> Column:
    """``upper_key_text`` of any text."""
    return of_any(c, lambda t: F.upper(F.btrim(F.regexp_replace(t, r"[\s\x1c-\x1f]+", " "))), upper_key_text)


def loose(c: Column) -> Column:
    """``loose_text`` of any text."""
    return of_any(c, lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^\w']+", " ")), loose_text)


def plain(c: Column) -> Column:
    """``plain_text`` of ASCII text, with SQL functions alone."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def plain_any(c: Column) -> Column:
    """``plain_text`` of any text; ASCII text, which SQL functions can do, is not sent to Python."""
    return of_any(c, plain, plain_text)


# ---------------------------------------------------------------- numbers and keys

# The patterns of numbers, years, centerings and kinds of defects in the functions below.


def collector_number(c: Column) -> Column:
    """Upper-cased part before the slash without blanks; digits lose leading zeros."""
    left = F.regexp_replace(F.get(F.split(F.upper(F.trim(F.coalesce(c, F.lit("")))), "/"), 0), r"\s+", "")
    return F.when(left.rlike(r"^\d+$"), F.when(F.ltrim(left, F.lit("0")) == "", "0").otherwise(F.ltrim(left, F.lit("0")))).otherwise(left)


def number_key(c: Column) -> Column:
    """``001/298`` -> ``1/298``, ``sp3/006`` -> ``SP3/6``: each part without leading zeros before a digit."""
    parts = F.split(F.upper(F.trim(F.coalesce(c, F.lit("")))), "/")
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^0+(?=\d)", "")), "/")


def number_after_hash(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, "#([^/]*)", 1))


def same_number(a: Column, b: Column) -> Column:
    """Equal upper-cased, or equal as integers."""
    whole = lambda c: F.when(F.trim(c).rlike(r"^\d+$"), F.expr("1").cast("int") * F.try_to_number(F.trim(c), F.lit("9999999999")))
    return (F.upper(F.trim(a)) == F.upper(F.trim(b))) | F.coalesce(whole(a) == whole(b), F.lit(False))


def first_year(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(\d{4})\b", 1).try_cast("int")


def card_key(name: Column, set_: Column, number: Column) -> Column:
    """Normalised name, set and number, so that spellings of one card give one key."""
    return F.concat_ws("|", *map(upper_key, (name, set_, number)))


def centering_shares(c: Column) -> Column:
    """The larger share of each axis of ``57L/43R 54T/46B``; null unless there are exactly four numbers."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)\s*[LRTB]"), 1), lambda x: x.cast("double"))
    at = lambda i: F.get(found, i)
    return F.when(F.size(found) == 4, F.struct(F.greatest(at(0), at(1)).alias("lr"), F.greatest(at(2), at(3)).alias("tb")))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def brackets(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\]]+)\]"), 1), lambda x: F.trim(x))


# ---------------------------------------------------------------- classifiers


def defect_kind(c: Column, strict: bool) -> Column:
    """Kind of a listed defect; ``strict``: unknown kinds are ``other``, and edges may be corners; else they are edges."""
    t = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.startswith(t, F.lit("centering")), F.lit(None).cast("string")).when(t.rlike("surface|crease|dent|roller|print|scratch"), "surface").when(F.contains(t, F.lit("corner")), "corner")
    return out.when(t.rlike("edge|bend|chip"), "edge_or_corner").otherwise("other") if strict else out.otherwise("edge")


def explains(side_a, location_a, type_a, side_b, location_b, type_b) -> Column:
    """Does flag b account for listed defect a? Same side, then corner to corner or edge to a named edge."""
    corner = F.replace(location_b, F.lit("_"), F.lit("")) == location_a
    corners = location_a.isin("topleft", "topright", "bottomleft", "bottomright") & corner & F.startswith(type_b, F.lit("corner"))
    kind = defect_kind(type_a, True)
    edge = (kind.isin("edge_or_corner", "other") | F.contains(type_a, F.lit("edge"))) & F.startswith(type_b, F.lit("edge")) & location_b.isin("top", "bottom", "left", "right") & F.contains(location_a, location_b)
    return (side_a == side_b) & (corners | F.coalesce(edge, F.lit(False)))


# ---------------------------------------------------------------- parsers in Python


def json_in_text(s: str | None) -> str | None:
    """The first balanced JSON object inside free text, compact; None without one."""
    for start in (m.start() for m in re.finditer(r"\{", s or "")):
        try:
            return json.dumps(json.JSONDecoder().raw_decode(s, start)[0], separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            continue
    return None


def jpeg_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the frame header, without decoding; None if malformed."""
    if not content or content[:2] != b"\xff\xd8":
        return None
    i = 2
    while (i := content.find(b"\xff", i)) >= 0 and i + 9 < len(content):  # stray bytes between segments are skipped
        marker = content[i + 1]
        if marker == 0xFF:
            i += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            i += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[i + 5 : i + 9])
            return width, height
        else:
            i += 2 + struct.unpack(">H", content[i + 2 : i + 4])[0]
    return None


def python_round(x: float | None, digits: int) -> float | None:
    """Round half to even on the exact binary value."""
    return None if x is None or x != x else round(x, digits)
