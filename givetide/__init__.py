"""Supporter-giving analytics as composable Spark DataFrame operators."""
