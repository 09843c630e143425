"""Event-study analytics as declarative PySpark plans."""
