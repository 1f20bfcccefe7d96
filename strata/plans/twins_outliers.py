"""The facts with outlier levels, also under their names of the round that brought the levels."""

from __future__ import annotations

from strata.plans.base import REGISTRY
from strata.plans.twins_pipelines import comex_pipeline, comtrade_gold_pipeline, survey_pipeline

REGISTRY["survey_outlier_pipeline"] = survey_pipeline
REGISTRY["comex_outlier_pipeline"] = comex_pipeline
REGISTRY["comtrade_outlier_pipeline"] = comtrade_gold_pipeline
