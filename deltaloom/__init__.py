"""Change and dependency analytics over DataFrames."""
