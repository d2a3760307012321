import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle_check import compare  # noqa: E402

from quire.plans import catalogue  # noqa: E402

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    got, want = compare(spark, sf_dir, catalogue.queries()[name], SQL[name])
    assert len(got) == len(want) and got == want
    assert got


def test_every_query_has_sql_but_the_png_files(spark, sf_dir):
    assert set(catalogue.queries()) - set(SQL) == {"png_images"}
    assert catalogue.queries()["png_images"](spark, sf_dir).where("length(png) > 40 and not png like '%\n%'").count() > 0
