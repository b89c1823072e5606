"""tidemark: time-series research analytics expressed as Spark DataFrames."""
