"""orbitlake: satellite-positioning analytics on PySpark DataFrames."""
