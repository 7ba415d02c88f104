"""Media-timeline analytics on Spark: ordered, timestamped records as DataFrames."""
