"""All registered queries and their SQL checks."""

from quillmark.catalog import cleaning, measuring, modelling, profiling, sampling, storage  # noqa: F401
from quillmark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
