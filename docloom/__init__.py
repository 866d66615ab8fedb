"""Document, markup, service-description, cell-grid and table analytics on Spark DataFrames."""
