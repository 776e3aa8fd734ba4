"""Spark-native analytics for excitation-emission fluorescence matrices."""
