"""Named queries over the tables of a folder, each with its SQL where SQL can express it."""

from . import descriptive, nearest, prepare, reports, training, wordwise
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "descriptive", "nearest", "prepare", "reports", "training", "wordwise"]
