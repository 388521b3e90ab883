"""Severity order as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.schemas import SEVERITIES, UNKNOWN_RANK


def severity_rank(severity: Column) -> Column:
    """0 for the most severe label; unknown and NULL labels rank last."""
    out = F
    for rank, label in enumerate(SEVERITIES):
        out = out.when(severity == label, F.lit(rank))
    return out.otherwise(F.lit(UNKNOWN_RANK))
