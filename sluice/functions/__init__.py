"""Scalar functions of the dialect as Spark SQL text: name -> builder(scope, arguments)."""

from __future__ import annotations

from . import arrays, dates, json, numbers, strings
from .core import FUNCTIONS, function, register_udfs

__all__ = ["FUNCTIONS", "arrays", "dates", "function", "json", "numbers", "register_udfs", "strings"]
