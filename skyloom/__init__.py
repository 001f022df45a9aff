"""Catalog resolution, search and coverage analytics as plain Spark DataFrame programs."""
