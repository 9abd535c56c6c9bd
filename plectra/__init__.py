"""Spark-native analytics over bounded symbolic-sequence design spaces."""
