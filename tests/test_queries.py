import pytest
from compare import SF, same_rows

from colloquy import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_rows(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_limits_refuse(spark):
    """The rows that are compared with SQL reach the case: every limit allows and refuses."""
    folder = SF.replace("sf0.001", "sf0.01")
    found = registry.queries()["limits_applied"](spark, folder).selectExpr("kind", "split(bucket_key, ':')[0] as action", "allowed", "error", "http_status").distinct().collect()
    assert {(r.kind, r.action) for r in found if not r.allowed} == {(r.kind, r.action) for r in found if r.allowed}
    assert len({(r.kind, r.action) for r in found}) == 6
    assert {(r.error, r.http_status) for r in found if not r.allowed} == {("rate_limit_exceeded", 429), ("quota_exceeded", 429)}
    for name in ("proxy_limit", "limiter_hot_key", "limiter_first_hit"):
        assert {r.allowed for r in registry.queries()[name](spark, folder).select("allowed").distinct().collect()} == {True, False}
