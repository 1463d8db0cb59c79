"""Whole runs and the queries built from operators."""
