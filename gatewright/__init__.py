"""Review-gate analytics and text operators on Spark DataFrames."""
