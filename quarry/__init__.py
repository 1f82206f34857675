"""Property-graph analytics on Spark: layered code and catalog graphs as DataFrames."""
