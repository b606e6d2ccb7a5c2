import pytest
from compare import SF, same_rows

from colloquy.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_rows(registry.queries()[name](spark, SF), registry.oracle_sql()[name])
