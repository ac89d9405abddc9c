"""The derived tables keep every event that belongs to them, at any scale factor."""

import duckdb
import pytest

from millwright.plans.fixtures import plant


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_products_are_the_purchases(spark, sf):
    folder = f"/root/testdata/{sf}"
    want = duckdb.sql(f"SELECT count(*) FROM '{folder}/events.parquet' WHERE event_type = 'purchase'").fetchall()[0][0]
    assert plant(spark, folder).oee_components.selectExpr("sum(ProductSum)").first()[0] == want


def test_no_view_is_left_behind(spark):
    plant(spark, "/root/testdata/sf0.001").oee_all.count()
    assert not [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(("_mw", "fx_", "ev"))]
