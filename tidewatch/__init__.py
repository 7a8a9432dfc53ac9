"""PySpark-native analytics for adoption-style time series."""
