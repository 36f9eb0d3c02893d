"""Association-aware relational queries compiled to lazy Spark DataFrames."""
