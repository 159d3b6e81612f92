"""Spark-native analytics over sparse data on a hierarchical spherical grid."""

__version__ = "0.1.0"
