"""Imports every module that registers queries."""

from checks import feature_checks, flag_checks, hot_checks, job_checks, metric_checks, report_checks, stream_checks  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
