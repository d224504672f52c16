"""tidegraph: network-shape analytics on Spark DataFrames."""
