"""Spark-first analytics over claims, evidence, verification runs and training text."""

__version__ = "0.1.0"
