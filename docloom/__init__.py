"""docloom: document-collection analytics on Spark DataFrames."""
