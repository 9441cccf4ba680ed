"""Document-to-panel analytics expressed as Spark DataFrames."""
