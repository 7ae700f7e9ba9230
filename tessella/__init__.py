"""Spark-native catalogue analytics: typed filters, hybrid retrieval, entity resolution, merges and measures."""
