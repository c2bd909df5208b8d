"""Borrowing the active session, or opening one that is stopped at the end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def open_session(app_name: str = "tablewright") -> Iterator[SparkSession]:
    active = SparkSession.getActiveSession()
    session = active or SparkSession.builder.appName(app_name).getOrCreate()
    try:
        yield session
    finally:
        if active is None:
            session.stop()
