"""Spark-native graph analytics and message propagation."""
