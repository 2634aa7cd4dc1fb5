"""Leakage-safe pregame analytics as Spark DataFrame transformations."""
