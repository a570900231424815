"""Point-in-time pricing and decision analytics on Spark DataFrames."""
