import pytest


@pytest.fixture
def tables(spark):
    from recbench.llm.common import Tables

    return Tables(spark)
