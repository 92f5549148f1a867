"""A media-library analytics engine on Spark DataFrames."""
