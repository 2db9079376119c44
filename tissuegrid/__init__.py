"""Spatial single-cell analytics expressed as Spark DataFrame jobs.

Every measurement is a keyed table: counts are ``(entity, gene, value)`` rows, cells are rows
with coordinates and feature arrays, graphs are edge tables, polygons are vertex or edge tables.
"""

__version__ = "0.1.0"
