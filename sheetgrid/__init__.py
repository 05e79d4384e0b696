"""Extract, validate and land spreadsheet-like grids with Spark DataFrames."""
