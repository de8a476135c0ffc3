"""Registered queries and composed reports."""
