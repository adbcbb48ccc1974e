"""All registered queries."""

from kinetable.plans import (  # noqa: F401
    conversion_queries, dataset_queries, episode_queries, folder_queries, frame_queries, source_queries,
    validation_queries,
)
from kinetable.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
