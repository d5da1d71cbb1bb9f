"""Record linkage with weighted, explainable scores, and the best candidates of each item by bounded postings.

A score is a sum of gains: number, name, set, version. What an entry can give an item in one respect is one of few kinds
(equal, one text inside the other, something else), so entries are posted under *tags* of each respect, and an item looks
up the tags under which its entries must lie, each with its gain. All entries of a posting give the item at least the sum
of its tags' gains, and exactly that in the most particular posting that holds them. So the k best of an item are among
the k smallest keys of its postings: only those are kept, whatever a posting's size, and nothing acceptable is lost.
Postings that can reach ``ACCEPT`` are looked up first; only items with fewer than k entries in them go on to the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.grades import num
from assayer.functions.tables import written
from assayer.functions.text import brackets, collector_number, plain_any

ACCEPT = 0.5


def _three(a: Column, b: Column, same: float, part: float, other: float) -> Column:
    """Equal, one in the other, or different; nothing if the wanted text is empty."""
    within = F.contains(a, b) | F.contains(b, a)
    return F.when(b == "", num(0)).when(a == b, num(same)).when(within, num(part)).otherwise(num(other))


def product_score(name: Column, console: Column, want_name: Column, want_number: Column, want_set: Column, finish: Column) -> Column:
    """Score of a priced product: number, name, set, and the version in square brackets; 0 to 1."""
    found = F.regexp_extract(name, r"#\s*([A-Za-z]*\d+[A-Za-z]*)", 1)
    number, wanted = collector_number(found), collector_number(want_number)
    by_number = F.when((wanted != "") & (number == wanted), num(0.45)).when((wanted != "") & (number != ""), num(-0.5)).otherwise(num(0))
    base = plain_any(F.regexp_replace(F.regexp_replace(name, r"\[[^\]]*\]", ""), r"#\s*\S+", ""))
    set_ = plain_any(F.regexp_replace(console, r"^(?i)(pokemon|riftbound)\s+", ""))
    version, look = plain_any(F.array_join(brackets(name), ", ")), plain_any(finish)
    hit = ((look != "") & F.contains(version, look)) | (F.contains(look, F.lit("reverse")) & F.contains(version, F.lit("reverse"))) | (F.contains(look, F.lit("foil")) & F.contains(version, F.lit("foil")))
    by_version = F.when(F.size(brackets(name)) == 0, num(0.05)).when(hit, num(0.05)).otherwise(num(-0.1))
    total = by_number + _three(base, plain_any(want_name), 0.25, 0.12, -0.2) + _three(set_, plain_any(want_set), 0.25, 0.1, -0.15) + by_version
    return F.greatest(num(0), F.least(num(1), F.round(total, 6)))


def catalog_score(name: Column, number: Column, set_: Column, want_name: Column, want_number: Column, want_set: Column) -> Column:
    """Score of a catalog card; a set also matches as whole words at either end."""
    n, w = collector_number(number), collector_number(want_number)
    by_number = F.when((w != "") & (n == w), num(0.45)).when((w != "") & (n != ""), num(-0.5)).otherwise(num(0))
    s, t = plain_any(set_), plain_any(want_set)
    ends = (s == t) | F.endswith(s, F.concat(F.lit(" "), t)) | F.startswith(s, F.concat(t, F.lit(" ")))
    by_set = F.when(t == "", num(0)).when((s != "") & ends, num(0.25)).when((s != "") & (F.contains(s, t) | F.contains(t, s)), num(0.12)).otherwise(num(-0.15))
    return F.greatest(num(0), F.least(num(1), F.round(by_number + _three(plain_any(name), plain_any(want_name), 0.25, 0.12, -0.2) + by_set, 6)))


def identify_score(base: Column, typed_name: Column, typed_number: Column, name: Column, total: Column) -> Column:
    """Score of an identified card: the lookup's base, moved by the typed name and the printed total where both sides
    have them; 0 to 1, two decimals half up."""
    a, b = plain_any(typed_name), plain_any(name)
    typed_total = F.get(F.split(F.regexp_replace(F.coalesce(typed_number, F.lit("")), r"\s+", ""), "/"), 1)
    printed = F.when(typed_total.rlike(r"^[0-9]+$"), typed_total.try_cast("double"))
    plus = F.when(base >= 0.85, num(0.05)).otherwise(num(0.2))
    by_name = F.when((F.coalesce(typed_name, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == ""), num(0)).when((a != "") & (F.contains(b, a) | F.contains(a, b)), plus).otherwise(num(-0.4))
    by_total = F.when(printed.isNull() | total.isNull(), num(0)).when(printed == total, plus).otherwise(num(-0.15))
    return F.floor(F.greatest(num(0), F.least(num(1), base + by_name + by_total)) * 100 + 0.5) / 100


# ---------------------------------------------------------------- postings

#: Tags are a letter and a text: "*" any entry; "=" the entry's own text; "<" a wanted text inside the entry's; "|" a
#: wanted text at either end of the entry's as whole words; "~" a word that a version and a look share; "-" no version.
#: Longest prefix of a wanted text by which the entries that hold it are found.
PREFIX = 8


@dataclass(frozen=True)
class Gains:
    """What a scorer gives. ``ends``: a wanted set at either end counts as equal; ``blank``: an entry's empty set lies in
    every wanted one; ``version``: gains with and without a fitting version, if the scorer looks at versions."""

    number: float = 0.45
    name: tuple[float, float, float] = (0.25, 0.12, -0.2)
    set: tuple[float, float, float] = (0.25, 0.1, -0.15)
    ends: bool = False
    blank: bool = True
    version: tuple[float, float] | None = (0.05, -0.1)


PRODUCT = Gains()
CATALOG = Gains(set=(0.25, 0.12, -0.15), ends=True, blank=False, version=None)
#: Words that fit each other in a version and a look, wherever they stand (fixed values).
LOOK_WORDS = ("reverse", "foil")


def _inside(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """text, inside: the wanted texts that lie in each entry's text without being it. Both sides are distinct texts. A
    wanted text is found by its first PREFIX characters, then compared."""
    text = F.col("text")
    starts = lambda q: F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    empty = F.array().cast("array<string>")
    grams = F.array_distinct(F.concat(*[F.when(F.length(text) >= q, starts(q)).otherwise(empty) for q in range(1, PREFIX + 1)]))
    own = entries.where("text <> ''").select("text", F.explode(grams).alias("gram"))
    found = own.join(wanted.where("text <> ''").select(F.col("text").alias("inside"), F.substring("text", 1, PREFIX).alias("gram")), "gram")
    return found.where(F.contains("text", F.col("inside")) & (F.col("text") != F.col("inside"))).select("text", "inside").distinct()


def _holding(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """text, held: distinct texts with what lies inside each (no more than a text has parts)."""
    held = pairs.groupBy("text").agg(F.collect_set("inside").alias("held"))
    return texts.join(held, "text", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))


def _tag(kind: str, text: Column) -> Column:
    return F.concat(F.lit(kind), text)


def _entry_tags(ends: bool) -> Column:
    """Tags under which an entry's text is posted in one respect."""
    own, held = F.col("text"), F.col("held")
    at_end = lambda w: F.endswith(own, F.concat(F.lit(" "), w)) | F.startswith(own, F.concat(w, F.lit(" ")))
    inside = F.transform(held, lambda w: F.when(at_end(w), _tag("|", w)).otherwise(_tag("<", w)) if ends else _tag("<", w))
    return F.concat(F.array(F.lit("*"), _tag("=", own)), inside)


def _gain(tag: Column, gain: float) -> Column:
    return F.struct(tag.alias("tag"), num(gain).alias("gain"))


def _item_tags(gains: tuple[float, float, float], ends: bool, blank: bool) -> Column:
    """Tags that an item's text looks up in one respect, with their gains; nothing is gained or lost by an empty text."""
    own, held = F.col("text"), F.col("held")
    same, part, other = gains
    tags = [_gain(F.lit("*"), other), _gain(_tag("=", own), same), _gain(_tag("<", own), part)]
    tags += [_gain(_tag("|", own), same)] if ends else []
    tags += [_gain(F.lit("="), part)] if blank else []
    return F.when(own == "", F.array(_gain(F.lit("*"), 0.0))).otherwise(F.concat(F.array(*tags), F.transform(held, lambda w: _gain(_tag("=", w), part))))


def _look_tags(hit: float, miss: float) -> Column:
    """Tags that a look looks up among versions; an entry without a version fits any."""
    own = F.when(F.col("text") == "", F.array().cast("array<struct<tag:string,gain:double>>")).otherwise(F.array(_gain(_tag("=", F.col("text")), hit), _gain(_tag("<", F.col("text")), hit)))
    return F.concat(F.array(_gain(F.lit("-"), hit), _gain(F.lit("*"), miss)), own, F.transform(_words(), lambda w: _gain(_tag("~", w), hit)))


def _words() -> Column:
    return F.filter(F.array(*map(F.lit, LOOK_WORDS)), lambda w: F.contains(F.col("text"), w))


def _met(entry_tags: DataFrame, item_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of distinct texts and tags (arrays) without the tags that the other side hasn't; an entry keeps ``*``,
    as an item's number may stand alone."""
    told = written(entry_tags.select("text", F.explode("tags").alias("tag")), "tags")
    asked = written(item_tags.select("text", F.explode("tags").alias("t")).select("text", "t.tag", "t.gain"), "tags")
    own = told.join(asked.select("tag").distinct(), "tag", "left_semi").groupBy("text").agg(F.collect_set("tag").alias("tags"))
    wanted = asked.join(told.select("tag").distinct(), "tag", "left_semi").groupBy("text").agg(F.collect_set(F.struct("tag", "gain")).alias("tags"))
    return own, wanted


def _tagged(df: DataFrame, column: str, tags: DataFrame) -> DataFrame:
    """``df`` with ``column``_tags; rows whose text meets nothing have none."""
    return df.join(tags.select(F.col("text").alias("_text"), F.col("tags").alias(f"{column}_tags")), F.coalesce(column, F.lit("\t")) == F.col("_text"), "left").drop("_text")


def _keys(numbers: Column, *tags: Column, gains: bool) -> Column:
    """All combinations of the tags, with the sum of the gains on the item's side."""

    def both(left: Column, right: Column) -> Column:
        if gains:
            return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(F.concat(a["tag"], F.lit("\n"), b["tag"]).alias("tag"), (a["gain"] + b["gain"]).alias("gain")))))
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("\n"), b))))

    return reduce(both, tags, numbers)


def _without(tags: Column, kinds: tuple[str, ...], gains: bool) -> Column:
    return F.filter(tags, lambda t: ~F.substring(t["tag"] if gains else t, 1, 1).isin(*kinds))


def _smallest(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """The k rows of each group with the smallest ``order``. Rows are dealt out by group and a sixteenth of its rows first:
    a task sorts no more than its partition, and of a group of any size only k rows a part meet in one task."""
    dealt = df.repartition(*by, F.pmod(F.xxhash64(order), F.lit(16)))
    first = Window.partitionBy(*by).orderBy(order)
    return dealt.withColumn("_p", F.row_number().over(first)).where(F.col("_p") <= k).drop("_p")


def _same(names: list[str]) -> Column:
    """Equal texts on both sides, nulls included; the right side's names end with ``_of``."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in names])


def top_matches(items: DataFrame, entries: DataFrame, gains: Gains, k: int = 2, accept: float = ACCEPT) -> DataFrame:
    """item, entry, score: the k best entries of each item, the smaller entry first among equals. ``items`` has item,
    number, name, set and (for scorers with versions) look; ``entries`` has entry, number, name, set and version (null:
    none), all normalised once by the caller. Candidates are all pairs of equal numbers, and pairs of which a side has
    no number if the names are equal and the sets equal or one in the other; no other pair is acceptable. Entries with
    the same texts score alike, so only the k smallest of them are posted; items with the same texts are looked up once."""
    texts = ["number", "name", "set"]
    told, asked_by = ([*texts, *c] if gains.version is not None else texts for c in (["version"], ["look"]))
    every = written(items.select("item", *asked_by), "every")
    entries = written(_smallest(entries.select("entry", *told), told, "entry", k), "entries")
    # from here on an item is a number that stands for its texts; written once, so the numbers stay
    items = written(every.select(*asked_by).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    stands = items.select(F.col("item").alias("_stands"), *[F.col(c).alias(f"{c}_of") for c in asked_by])
    parts = {"name": (gains.name, False, True), "set": (gains.set, gains.ends, gains.blank)}
    for c, (of, ends, blank) in parts.items():
        e, i = (d.select(F.col(c).alias("text")).distinct() for d in (entries, items))
        own = _holding(e, _inside(e, i)).select("text", _entry_tags(ends).alias("tags"))
        wanted = _holding(i, _inside(i, e)).select("text", _item_tags(of, ends, blank).alias("tags"))
        own, wanted = _met(own, wanted)
        entries, items = _tagged(entries, c, own), _tagged(items, c, wanted)
    if gains.version is not None:
        # a tab stands for no version: no normalised text has one
        e, i = entries.select(F.coalesce("version", F.lit("\t")).alias("text")).distinct(), items.select(F.col("look").alias("text")).distinct()
        own = _holding(e, _inside(e, i)).select("text", F.when(F.col("text") == "\t", F.array(F.lit("-"))).otherwise(F.concat(_entry_tags(False), F.transform(_words(), lambda w: _tag("~", w)))).alias("tags"))
        own, wanted = _met(own, i.select("text", _look_tags(*gains.version).alias("tags")))
        entries, items = _tagged(entries, "version", own), _tagged(items, "look", wanted)
        version, look = F.col("version_tags"), F.col("look_tags")
    else:
        version, look = F.array(F.lit("*")), F.array(_gain(F.lit("*"), 0.0))
    has = F.col("number") != ""
    only = lambda tags, text, gained: F.filter(tags, lambda t: (t["tag"] if gained else t) == _tag("=", F.col(text)))
    by_number = F.when(has, _keys(F.array(_tag("#", F.col("number"))), F.col("name_tags"), F.col("set_tags"), version, gains=False))
    unnumbered = _keys(F.array(F.when(has, "1").otherwise("0")), only(F.col("name_tags"), "name", False), _without(F.col("set_tags"), ("*",), False), version, gains=False)
    posted = entries.select("entry", F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (by_number, unnumbered)])).alias("key"))
    postings = written(_smallest(posted, ["key"], "entry", k), "postings")
    by_number = F.when(has, _keys(F.array(_gain(_tag("#", F.col("number")), gains.number)), F.col("name_tags"), F.col("set_tags"), look, gains=True))
    lacking = F.when(has, F.array(_gain(F.lit("0"), 0.0))).otherwise(F.array(_gain(F.lit("0"), 0.0), _gain(F.lit("1"), 0.0)))
    unnumbered = F.when((F.col("name") != "") & (F.col("set") != ""), _keys(lacking, only(F.col("name_tags"), "name", True), _without(F.col("set_tags"), ("*",), True), look, gains=True))
    none = F.array().cast("array<struct<tag:string,gain:double>>")
    asked = items.select("item", F.explode(F.concat(*[F.coalesce(x, none) for x in (by_number, unnumbered)])).alias("k"))
    asked = written(asked.select("item", F.col("k.tag").alias("key"), F.round("k.gain", 6).alias("bound")), "asked")

    def found(part: DataFrame) -> DataFrame:
        """An entry's score is the bound of the most particular posting that holds it."""
        return part.join(postings, "key").groupBy("item", "entry").agg(F.max("bound").alias("bound"))

    high = written(found(asked.where(F.col("bound") >= accept)), "high")
    done = high.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("item")
    rest = asked.where(F.col("bound") < accept).join(done, "item", "left_anti")
    both = high.unionByName(found(rest)).groupBy("item", "entry").agg(F.max("bound").alias("bound"))
    score = F.greatest(num(0), F.least(num(1), F.col("bound")))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), "entry")
    top = lambda d: d.withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= k).drop("_p")
    found_by_texts = written(top(both.select("item", "entry", score.alias("score"))), "top")
    own = every.join(stands, _same(asked_by)).select("item", "_stands").join(found_by_texts.withColumnRenamed("item", "_stands"), "_stands")
    # an item that is given with several texts has the best of all
    return top(own.groupBy("item", "entry").agg(F.max("score").alias("score")))


def wanted_items(items: DataFrame, item: str, name: Column, number: Column, set_: Column, look: Column | None = None, normal: Callable[[Column], Column] = plain_any) -> DataFrame:
    """Items as ``top_matches`` takes them."""
    return items.select(F.col(item).alias("item"), collector_number(number).alias("number"), normal(name).alias("name"), normal(set_).alias("set"), normal(F.lit("") if look is None else look).alias("look"))


def product_entries(products: DataFrame, entry: str, name: Column, console: Column, normal: Callable[[Column], Column] = plain_any) -> DataFrame:
    """Priced products as ``top_matches`` takes them: number, bare name and bracketed version are taken from the name."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\[[^\]]*\]", ""), r"#\s*\S+", "")
    version = F.when(F.size(brackets(name)) > 0, normal(F.array_join(brackets(name), ", ")))
    number = collector_number(F.regexp_extract(F.coalesce(name, F.lit("")), r"#\s*([A-Za-z]*\d+[A-Za-z]*)", 1))
    return products.select(F.col(entry).alias("entry"), number.alias("number"), normal(bare).alias("name"), normal(F.regexp_replace(console, r"^(?i)(pokemon|riftbound)\s+", "")).alias("set"), version.alias("version"))


def catalog_entries(cards: DataFrame, entry: str, name: Column, number: Column, set_: Column, normal: Callable[[Column], Column] = plain_any) -> DataFrame:
    """Catalog cards as ``top_matches`` takes them."""
    return cards.select(F.col(entry).alias("entry"), collector_number(number).alias("number"), normal(name).alias("name"), normal(set_).alias("set"))


def best_match(scored: DataFrame, item: str, score: str, tie: str, accept: float = ACCEPT, rival: float = 0.05) -> DataFrame:
    """The best candidate of each item with score, runner-up's score and whether a person should choose."""
    w = Window.partitionBy(item).orderBy(F.col(score).desc(), F.col(tie))
    ranked = scored.withColumn("_place", F.row_number().over(w)).where("_place <= 2")
    best = ranked.groupBy(item).agg(F.min_by(tie, "_place").alias("best"), F.max(score).alias("score"), F.max(F.when(F.col("_place") == 2, F.col(score))).alias("runner_up"))
    return best.withColumns({"accepted": F.col("score") >= accept, "needs_choice": (F.col("score") < accept) | (F.coalesce(F.col("runner_up"), num(-1)) >= F.col("score") - rival)})


def decisive(scored: DataFrame, item: str, score: str, tie: str, least: float = 0.9, ahead: float = 0.3) -> DataFrame:
    """Items whose best candidate is good enough and far enough ahead."""
    best = best_match(scored, item, score, tie)
    return best.select(item, "best", "score", ((F.col("score") >= least) & (F.col("score") - F.coalesce("runner_up", num(0)) >= ahead)).alias("decisive"))


def keep_best(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def fallback_join(items: DataFrame, by_id: DataFrame, by_pair: DataFrame, id_: str, pair: list[str], value: str) -> DataFrame:
    """Value by id, else by a pair of keys; both right sides have one row per key."""
    a = by_id.select(id_, F.col(value).alias("_a"))
    b = by_pair.select(*pair, F.col(value).alias("_b"))
    out = items.join(a, id_, "left").join(b, pair, "left")
    return out.withColumn(value, F.coalesce("_a", "_b")).withColumn("source", F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "pair")).drop("_a", "_b")


def votes(reads: DataFrame, item: str, number: str, confidence: str, slash: str, set_: str, order: str) -> DataFrame:
    """Voting over repeated reads: a number's rank is its count, best confidence, half a point with a total and 0.3 with
    a set; a conflict is a runner-up with as many reads as the winner."""
    per = reads.groupBy(item, number).agg(F.count(F.lit(1)).alias("n"), F.max(confidence).alias("top"), F.bool_or(slash).alias("slash"), F.min_by(set_, F.when(F.col(set_).isNotNull(), F.col(order))).alias("set"))
    per = per.withColumn("rank", F.col("n") + F.col("top") + F.when(F.col("slash"), 0.5).otherwise(0.0) + F.when(F.col("set").isNotNull(), 0.3).otherwise(0.0))
    w = Window.partitionBy(item).orderBy(F.col("rank").desc(), number)
    out = per.withColumns({"_place": F.row_number().over(w), "next_n": F.lead("n").over(w)}).where("_place = 1")
    return out.select(item, number, "n", "rank", "set", (F.coalesce("next_n", F.lit(0)) >= F.col("n")).alias("conflict"))
