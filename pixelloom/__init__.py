"""Spark-native preparation, inspection and batching of training datasets."""
