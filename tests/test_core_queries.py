import pytest

from fieldglass.plans import core_queries as C
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(C.ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    agree(C.QUERIES[name](spark, sf), C.ORACLES[name], sf)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "sourceId", "targetId", "type", "label", "weight", "some_name", "timestamp"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rows_only_queries_give_a_row_each(spark, sf):
    assert C.QUERIES["command_lines_masked"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_window_filters_reach_the_scan(spark, sf):
    plan = C.dump_window(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_bucket_counts_read_no_other_columns_and_shuffle_once(spark, sf):
    plan = C.dump_bucket_counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "value:double" not in plan and plan.count("Exchange hashpartitioning") == 1
