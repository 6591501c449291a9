"""algoscape: algorithm-assessment analytics over Spark DataFrames."""
