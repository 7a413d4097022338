"""lectern: Markdown readability analytics on Spark DataFrames."""
