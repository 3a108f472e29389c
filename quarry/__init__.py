"""quarry: technology-intelligence analytics expressed as Spark DataFrames."""
