"""Spark-native analytics for rows that pair attributes with a trajectory."""
