"""Spark-native panel analytics: point-in-time panels, cross-sections, events and panel inference."""
