"""Reading-library analytics as PySpark DataFrame transformations."""
