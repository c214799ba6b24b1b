"""Posting analytics as composable Spark DataFrame transformations."""
