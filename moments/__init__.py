"""Spark-native engine for finding the moments worth keeping in recordings and photo sets."""
