"""Spark-native catalog audit: profile, classify, ground, score and search a lake's tables."""
