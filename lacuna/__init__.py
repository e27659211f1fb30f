"""Why-not provenance for Spark DataFrames."""
