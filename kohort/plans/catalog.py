"""Imports every query module so the registry is complete."""

from kohort.plans import (  # noqa: F401
    q_aggregate, q_columns, q_cox, q_filters, q_pipelines, q_scalar, q_summary, q_survival)
from kohort.plans.registry import ORACLES, QUERIES  # noqa: F401
