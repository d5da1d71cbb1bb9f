
import pytest

import __spark_entry__ as entry
from tests.tests_support import check

LLM = ("op", "pipeline")


def names():
    return [n for n in entry.queries() if not n.startswith(LLM)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert not [n for n in names() if n not in entry.oracle_sql()]


@pytest.mark.parametrize("name", names())
def test_query_equals_its_oracle(spark, name):
    check(spark, name, "sf0.001")
