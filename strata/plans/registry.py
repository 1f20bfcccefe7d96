"""Collects the twin queries from every plan module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strata.plans import twins, twins_analyses, twins_controls, twins_crops, twins_dash, twins_golds, twins_incremental, twins_logs, twins_marts, twins_ops, twins_reads, twins_more, twins_outliers, twins_pipelines, twins_rollups, twins_sources, twins_whole  # noqa: F401  (modules register themselves)
    from strata.plans.base import REGISTRY

    return dict(REGISTRY)
