"""Views over hot and cold tables."""

from emberline.sources import catalog
from emberline.sources.views import DomainTables


def test_views_join_across_stores(spark):
    names = catalog.register_domain(DomainTables(spark, "/root/testdata/sf0.001"))
    assert set(names) <= set(catalog.views(spark)) and len(names) == 32
    assert catalog.columns(spark, "cold_iot_hourly_aggregates")["p95_value"] == "decimal(12,4)"
    assert catalog.sample(spark, "hot_iot_readings", 5).count() == 5
    joined = spark.sql("SELECT 1 FROM hot_financial_accounts JOIN cold_financial_transactions_archive USING (account_id)")
    assert joined.count() > 0
