"""Two-version resolution engine on PySpark."""
