"""Incremental upkeep of monthly cells."""
