"""Chat-log dataset engine on PySpark."""
