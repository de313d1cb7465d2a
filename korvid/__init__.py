"""korvid: an analytics engine for object-shaped tables, declared on PySpark DataFrames."""
