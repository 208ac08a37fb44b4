"""quarry: append-only record blocks on PySpark."""
