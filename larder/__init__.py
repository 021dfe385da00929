"""larder: recipe and cooking-history analytics written as Spark DataFrames."""
