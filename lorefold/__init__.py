"""Document-intelligence operators on PySpark DataFrames."""
