"""All registered queries."""

from . import aggregates, filters, flagship, frames, graph, joins, kernels, scalar, solving, text  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
