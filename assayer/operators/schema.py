"""Validation of nested records against a schema document, compiled to one column expression over VARIANT.

A document is a dict: ``type`` (a name or a list of names: object, array, string, number, integer, boolean, null),
``required`` (names), ``properties`` (name to document), ``values`` (document of every value of an object that is used as
a map), ``items`` (document of every element), ``enum``, ``pattern`` (of the whole text), ``min`` and ``max``. Messages name
the place: ``$.tag.ding_list[2].side: not one of front, back``. A value of a wrong type has no other errors; a record that
isn't JSON has one. The expression grows with the document, never with the records.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How VARIANT names the types of a document.
TYPES = {"object": "OBJECT.*", "array": "ARRAY.*", "string": "STRING", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "integer": "(BIGINT|DECIMAL\\(\\d+,0\\))", "boolean": "BOOLEAN", "null": "VOID"}
_NONE = "array<string>"


def _names(kind: str | Iterable[str]) -> list[str]:
    return [kind] if isinstance(kind, str) else list(kind)


def _when(test: Column, message: Column) -> Column:
    """An array with the message if the test holds."""
    return F.when(test, F.array(message)).otherwise(F.array().cast(_NONE))


def _errors(value: Column, schema: dict, path: Column) -> Column:
    kinds = _names(schema.get("type", []))
    kind = F.schema_of_variant(value)
    say = lambda text: F.concat(path, F.lit(f": {text}"))
    found = []
    text = F.try_variant_get(value, "$", "string")
    if "enum" in schema:
        names = [str(x) for x in schema["enum"]]
        found.append(_when(~F.coalesce(text.isin(names), F.lit(False)), say(f"not one of {', '.join(names)}")))
    if "pattern" in schema:
        found.append(_when((kind == "STRING") & ~text.rlike(f"^(?:{schema['pattern']})$"), say("malformed")))
    number = F.try_variant_get(value, "$", "double")
    for bound, bad in (("min", lambda x: number < x), ("max", lambda x: number > x)):
        if bound in schema:
            found.append(_when(F.coalesce(bad(schema[bound]), F.lit(False)), say(f"{bound} is {schema[bound]}")))
    required = set(schema.get("required", ()))
    own = schema.get("properties", {})
    for name in [*own, *sorted(required - own.keys())]:
        child = F.try_variant_get(value, f"$['{name}']", "variant")
        at = F.concat(path, F.lit(f".{name}"))
        missing = _when(child.isNull(), F.concat(at, F.lit(": missing"))) if name in required else F.array().cast(_NONE)
        found.append(F.when(child.isNull(), missing).otherwise(_errors(child, own.get(name, {}), at)))
    if "values" in schema:
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        found.append(F.flatten(F.transform(entries, lambda e: _errors(e["value"], schema["values"], F.concat(path, F.lit("."), e["key"])))))
    if "items" in schema:
        elements = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.flatten(F.transform(elements, lambda x, i: _errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    inner = F.concat(*[F.coalesce(f, F.array().cast(_NONE)) for f in found]) if found else F.array().cast(_NONE)
    if not kinds:
        return inner
    fits = kind.rlike("^(?:" + "|".join(TYPES[k] for k in kinds) + ")$")
    if "null" in kinds:
        inner = F.when(kind == "VOID", F.array().cast(_NONE)).otherwise(inner)
    return F.when(fits, inner).otherwise(F.array(F.concat(path, F.lit(f": not {' or '.join(kinds)}"))))


def schema_errors(record: Column, schema: dict) -> Column:
    """Messages of a JSON text's errors, in the order of the document."""
    value = F.try_parse_json(record)
    return F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_errors(value, schema, F.lit("$")))


def schema_of_rules(rules: Iterable) -> dict:
    """A document from rows of a rule table: path (``tag.ding_list[].side``; ``images.*.bytes`` for maps), type (names
    joined by ``|``), required, enum (joined by ``|``) and pattern; null where there is none. Rows may be in any order;
    their number bounds the expression."""
    root: dict = {"type": "object"}
    for r in sorted(rules, key=lambda r: r["path"]):
        at = root
        steps = r["path"].replace("[]", ".[]").split(".")
        for i, step in enumerate(steps):
            last = i == len(steps) - 1
            if step in ("[]", "*"):
                at = at.setdefault("items" if step == "[]" else "values", {})
            else:
                if last and r["required"]:
                    at.setdefault("required", []).append(step)
                at = at.setdefault("properties", {}).setdefault(step, {})
        at["type"] = r["type"].split("|")
        if r["enum"] is not None:
            at["enum"] = r["enum"].split("|")
        if r["pattern"] is not None:
            at["pattern"] = r["pattern"]
    return root
