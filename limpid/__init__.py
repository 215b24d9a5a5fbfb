"""limpid: profile, repair and score tables with Spark DataFrames."""
