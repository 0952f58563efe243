"""Warehouse topology, lineage and provenance analytics as Spark DataFrames."""
