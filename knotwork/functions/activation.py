"""The activation function of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transfer(activation: Column, mass: Column, total: Column, n: Column) -> Column:
    """What a node passes on over one edge: activation / n * logistic(((mass * n / total) - 1) / 2)."""
    return activation / n * (F.lit(1.0) / (F.lit(1.0) + F.exp(-((mass * n / total - F.lit(1.0)) * F.lit(0.5)))))
