"""All registered queries of the library proper."""

from . import governance, pages, streaming, tables, telemetry  # noqa: F401  (they register themselves)
from .fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
