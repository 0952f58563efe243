"""Operators on graphs, row lineage, answers, text and samples."""
