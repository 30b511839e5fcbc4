"""Code-intelligence analytics on DataFrames."""
