"""Spark-native analytics for scanning diffraction data and iterative phase retrieval."""
