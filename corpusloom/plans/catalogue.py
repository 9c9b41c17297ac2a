"""All queries of the engine by name, with their SQL equivalents."""

from . import files, keyed, metadata, streams, training
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "keyed", "metadata", "streams", "training"]
