"""swelter: heat-exposure and training-data jobs for Spark DataFrames."""
