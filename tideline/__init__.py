"""Stream-log analytics on PySpark: streams are DataFrames of (segment, offset, event)."""
