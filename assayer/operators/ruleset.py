"""All rule tables as data: read from rule files (or any mapping), put in force for a while, edited ones count at once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import cache
from types import FunctionType

from pyspark.sql import SparkSession

from assayer.operators import grading
from assayer.plans import criteria
from assayer.sources.formats import rules_of

_TABLES = {n: v for n, v in vars(criteria).items() if n.isupper()}


def _frozen(x):
    """Lists as tuples, as the tables are written."""
    return tuple(map(_frozen, x)) if isinstance(x, list | tuple) else {k: _frozen(v) for k, v in x.items()} if isinstance(x, dict) else x


def document() -> dict:
    """The tables in force, as JSON has them; ``rule_files`` reads it back."""
    return json.loads(json.dumps({n.lower(): getattr(criteria, n) for n in _TABLES}))


def version() -> str:
    """A name of the rules in force: 12 hex digits of their content."""
    return hashlib.sha256(json.dumps(document(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def of_files(spark: SparkSession, path: str) -> dict:
    """Tables of all rule files of a folder; a table that is no list has one row there. Names that no scheme knows are an
    error."""
    out = {}
    for tables in rules_of(spark, path).values():
        for name, rows in tables.items():
            old = _TABLES.get(name.upper())
            if old is None:
                raise KeyError(f"no rule table {name}")
            out[name.upper()] = _frozen(rows if isinstance(old, tuple) else rows[0])
    return out


def _forget() -> None:
    """Columns that were built from other tables are void."""
    for f in vars(grading).values():
        if not isinstance(f, FunctionType) and isinstance(f, type(cache(lambda: None))):
            f.cache_clear()


@contextmanager
def in_force(tables: Mapping[str, object]) -> Iterator[None]:
    """Grade under ``tables`` (name to rows) inside the block; others stay as they are. Frames that were made inside keep
    its rules."""
    unknown = {n.upper() for n in tables} - _TABLES.keys()
    if unknown:
        raise KeyError(f"no rule table {', '.join(sorted(unknown))}")
    before = {n.upper(): getattr(criteria, n.upper()) for n in tables}
    try:
        for n, v in tables.items():
            setattr(criteria, n.upper(), _frozen(v))
        _forget()
        yield
    finally:
        for n, v in before.items():
            setattr(criteria, n, v)
        _forget()
