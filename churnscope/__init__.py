"""churnscope: data audit, cleaning and cohort metrics as Spark DataFrame operators."""

from churnscope import functions, operators, plans, sources

__all__ = ["functions", "operators", "plans", "sources"]
