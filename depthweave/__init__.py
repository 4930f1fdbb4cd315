"""Market-by-order analytics and training-data operators on Spark DataFrames."""
