"""Loads every query module, so that the registry is full."""

from furrow.plans import basic_queries, file_queries, model_queries, summary_queries, trend_queries  # noqa: F401
from furrow.plans.catalog import QUERIES, SQL  # noqa: F401
