"""Every operator as a query on the test tables, with its SQL where SQL can express it."""

from . import core, stores, streams, texts  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
