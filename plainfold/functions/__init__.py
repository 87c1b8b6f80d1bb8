"""Scalar functions live in ``plainfold.sql.lower``, which maps each one of the dialect to a Spark expression."""
