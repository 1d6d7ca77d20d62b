"""Road-sensor analytics on Spark: every operator is a function of DataFrames."""
