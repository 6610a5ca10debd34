"""Spark-native analytics for aerial surveys, flight logs and crowd labels."""
