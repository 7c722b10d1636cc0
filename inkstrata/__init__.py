"""Document-structure analytics as Spark DataFrame transformations."""
