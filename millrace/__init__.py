"""millrace: analytics operators as composable PySpark DataFrame transformations."""

__version__ = "0.1.0"
