"""A PySpark engine for identifier safety and look-alike text."""
