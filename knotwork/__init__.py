"""knotwork: weighted knowledge graphs over text collections, on Spark DataFrames."""
