"""graphloom: analytics over graphs that change over time, on plain PySpark DataFrames."""
