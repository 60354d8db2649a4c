"""Query and table operators on DataFrames."""
