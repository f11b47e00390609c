"""Spark-native analytics over typed documents, dependency graphs, signals and clocks."""
