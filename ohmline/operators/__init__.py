"""Operators on ordered series, logs, samples and fleets."""
