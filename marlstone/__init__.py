"""marlstone: operational and media-inventory analytics on PySpark DataFrames."""
