"""Public-record analytics as composable Spark DataFrame operators."""
