"""Document analytics on Spark: relational and scalar operators over tables of objects."""
