"""Profiling and preparation of large tables with Spark DataFrames."""

from tableprobe.session import configure, local_session

__all__ = ["configure", "local_session"]
