"""flatscan: a Spark-native toolkit for exact scans of flat Parquet tables."""

__version__ = "0.1.0"
