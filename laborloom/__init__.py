"""laborloom: a PySpark-native analytics engine for job-posting data."""

__version__ = "0.1.0"
