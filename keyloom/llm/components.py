"""Connected components of an edge table, staged as this subpackage stages its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import components
from .common import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long), any direction, repeats and loops allowed -> (node, component); see ``operators.components``."""
    return components.connected_components(edges, stage, max_rounds)
