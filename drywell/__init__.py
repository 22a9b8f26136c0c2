"""drywell: drought-index analytics on Spark DataFrames."""
