"""A PySpark engine for spatial graph queries."""
