"""paperlake: document extraction and corpus preparation on Spark DataFrames."""
