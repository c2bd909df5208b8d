"""Comparing a stream's batches with a table."""

from .reconcile import reconcile

__all__ = ["reconcile"]
