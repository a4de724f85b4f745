"""corpusloom: corpus ranking, context budgeting and training-data operators on Spark DataFrames."""
