"""Tessera: a multi-model analytics engine expressed on Spark DataFrames."""
