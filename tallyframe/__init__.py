"""Build, check and score large annotated datasets with Spark DataFrames."""
