"""Evidence-first, point-in-time analytics as composable PySpark transformations."""
