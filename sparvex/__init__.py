"""A PySpark engine for collections of embedding vectors and for preparing training data."""

__version__ = "0.1.0"
