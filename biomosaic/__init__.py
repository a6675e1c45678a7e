"""Species habitat analytics as plain Spark DataFrame transformations."""
