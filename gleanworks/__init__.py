"""Relevance analytics on Spark: DataFrame operators for labelled, unit-level documents."""
