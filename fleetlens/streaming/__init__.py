"""The same bucketed counts over streaming DataFrames."""
