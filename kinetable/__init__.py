"""Curation of recorded robot demonstrations as Spark DataFrame jobs."""

from kinetable.settings import prepare

__all__ = ["prepare"]
