"""All registered queries of the catalogue engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkcatalog.plans import catalog, collecting, flows, jobs, rulings, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog.QUERIES | texts.QUERIES | rulings.QUERIES | collecting.QUERIES | flows.QUERIES | jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.SQL | texts.SQL | rulings.SQL | collecting.SQL | flows.SQL | jobs.SQL
