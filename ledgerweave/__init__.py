"""Spark-native ownership-graph analytics: money trails, name resolution and issue scores."""
