"""Synthetic tables on Spark: profile a table, model it, sample from the model, and compare."""
