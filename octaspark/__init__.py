"""octaspark: large coloured 3-D point tables as Spark DataFrames."""
