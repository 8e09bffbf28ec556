"""Data-quality checks, scoring, star-schema history and analytics on Spark."""
