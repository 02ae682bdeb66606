"""Scalar functions that Spark lacks, as expressions of those that it has."""
