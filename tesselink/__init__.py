"""tesselink: a record-linkage engine expressed as Spark DataFrames."""
