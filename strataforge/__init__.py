"""strataforge: Spark-native analytics over content-addressed, versioned data."""

__version__ = "0.1.0"
