"""Set-at-a-time operators: DataFrames and parameters in, DataFrame out."""
