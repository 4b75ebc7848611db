"""Cohort and prevalence analytics over health-insurance claims, on Spark."""

from prevalo import functions, operators, sources

__all__ = ["functions", "operators", "sources"]
