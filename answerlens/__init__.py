"""Brand-visibility analytics over large collections of generated answers, built on Spark DataFrames."""
