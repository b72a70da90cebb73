"""Spark-native analytics for large collections of atomistic structures."""

from .session import build_session, tune

__all__ = ["build_session", "tune"]
