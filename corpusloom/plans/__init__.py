"""Whole runs built from operators, and the queries over the test tables."""
