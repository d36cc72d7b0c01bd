"""Named views over live and historical tables, for questions asked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .views import DomainTables

HOT = {
    "iot": ("device_state", "readings", "alerts_open"),
    "commerce": ("commerce_customers", "products", "active_carts", "orders_inflight", "live_sessions"),
    "financial": ("financial_customers", "accounts", "transactions_authorizing", "card_transactions", "transfers_pending", "fraud_alerts"),
}
COLD = {
    "iot": ("hourly_aggregates", "daily_site_summary", "weather_by_location", "failure_history", "firmware_deployments", "maintenance_windows"),
    "commerce": ("orders_archive", "order_items", "daily_sales", "customer_ltv", "cohort_retention", "competitor_prices"),
    "financial": ("transactions_archive", "risk_history", "fraud_labels", "portfolio_metrics", "filings", "market_data"),
}


def register(tables: dict[str, DataFrame]) -> None:
    """Make each DataFrame a view of that name. Views of different sources join in one plan."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_domain(tables: DomainTables, *domains: str) -> list[str]:
    """Views ``hot_<domain>_<table>`` and ``cold_<domain>_<table>``; returns their names."""
    named: dict[str, DataFrame] = {}
    for prefix, groups in (("hot", HOT), ("cold", COLD)):
        for domain in domains or groups:
            for table in groups[domain]:
                named[f"{prefix}_{domain}_{table}"] = getattr(tables, table)()
    register(named)
    return list(named)


def views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def columns(spark: SparkSession, view: str) -> dict[str, str]:
    """Column names and SQL types as the catalog knows them."""
    return {c.name: c.dataType for c in spark.catalog.listColumns(view)}


def sample(spark: SparkSession, view: str, rows: int = 20) -> DataFrame:
    """A few rows to look at, in no particular order."""
    return spark.table(view).limit(rows)
