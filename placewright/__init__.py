"""Spark-native places analytics: scans, conflation, repair, ranking, search and leads as DataFrame plans."""
