"""attestor: evidence analytics as composable Spark DataFrame transformations."""
