"""Provenance matching engine: DataFrame-in, DataFrame-out operators for Spark."""
