"""Tessella: a PySpark analytics library of composable DataFrame operators."""

__all__ = ["functions", "operators", "plans", "session", "sources", "streaming"]
