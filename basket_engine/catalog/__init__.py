"""All registered queries; importing the package fills the registry."""

from . import files, fitting, purchases, rules, sequences, tables, texts, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
