"""Event validation, windowed aggregates and rule evaluation on Spark DataFrames."""
