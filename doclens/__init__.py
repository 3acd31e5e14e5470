"""doclens: document-collection analytics on PySpark DataFrames."""
