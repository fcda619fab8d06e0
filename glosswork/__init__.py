"""Spark-native corpus translation: select, batch, translate, validate, assemble."""

from glosswork.options import RunOptions
from glosswork.session import configure

__all__ = ["RunOptions", "configure"]
