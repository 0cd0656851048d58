"""lexmill: a PySpark-native engine for collections of legal documents."""

__version__ = "0.1.0"
