"""gridloom: composable, Spark-native analytics operators for geospatial and tabular corpora."""

__version__ = "0.1.0"
