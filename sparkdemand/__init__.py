"""Sales analytics and demand forecasting as Spark DataFrame jobs."""

from sparkdemand.operators.clean import CleanOptions, clean_dataset
from sparkdemand.operators.features import FeatureConfig
from sparkdemand.operators.roles import Roles, detect_frequency, detect_roles
from sparkdemand.plans.pipeline import Result, run_pipeline

__all__ = [
    "CleanOptions",
    "FeatureConfig",
    "Result",
    "Roles",
    "clean_dataset",
    "detect_frequency",
    "detect_roles",
    "run_pipeline",
]
