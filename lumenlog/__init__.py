"""lumenlog: incident and diagnostic analytics on Spark DataFrames."""
