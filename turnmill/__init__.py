"""turnmill: conversation curation on Spark DataFrames."""
