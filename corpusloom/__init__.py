"""Spark-native preparation of image-text and text corpora."""
