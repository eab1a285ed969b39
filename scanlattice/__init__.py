"""scanlattice: corpus-scanning analytics on Spark DataFrames."""
