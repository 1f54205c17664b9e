"""Spark-native georeferencing of image series with ground control points."""
