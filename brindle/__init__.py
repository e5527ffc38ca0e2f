"""brindle: property-graph, text and evaluation analytics on PySpark DataFrames."""
