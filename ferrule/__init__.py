"""Spark-native analytics for technical catalogues: normalise, extract, classify, gate, search, compare."""
