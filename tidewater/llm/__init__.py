"""Operators for large training-data pipelines.

Nothing outside this folder imports it; ``queries`` and ``oracle`` modules
register its queries through ``__spark_entry__.py`` when the folder exists.
"""
