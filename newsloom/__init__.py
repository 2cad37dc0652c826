"""A news and document analytics library for PySpark."""
