"""Evidence-linked text analytics on Spark DataFrames."""
