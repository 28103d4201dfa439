"""A semantic-memory analytics engine on Spark DataFrames."""
