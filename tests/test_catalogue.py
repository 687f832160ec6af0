import pytest
from compare import differences

import __spark_entry__
from slate.plans import catalogue, extras, variants  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
