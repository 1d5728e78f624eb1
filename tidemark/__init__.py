"""tidemark: a PySpark-native analytics engine with a PostgreSQL-flavoured surface."""

__version__ = "0.1.0"
