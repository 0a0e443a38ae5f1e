"""Document-extraction and metering analytics on Spark DataFrames."""
