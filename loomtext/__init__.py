"""Narrative-text analytics as Spark DataFrame plans."""
