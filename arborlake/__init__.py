"""An analytics engine for code and document graphs on Spark DataFrames."""
