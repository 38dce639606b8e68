"""Student-success analytics as lazy, composable PySpark DataFrame operators."""
