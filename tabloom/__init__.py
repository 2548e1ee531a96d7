"""Prepare, check and understand tables with PySpark."""
