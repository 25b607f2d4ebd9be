"""Lodestone: a PySpark-native engine for catalogue, price, retrieval and corpus work."""
