"""Ohmline: time-series, log and fleet-energy analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
