"""Gridlark: screening, retrieval and resource analytics as PySpark jobs."""
