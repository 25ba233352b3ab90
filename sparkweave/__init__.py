"""Sparkweave: a Spark-native engine for knowledge-graph construction and text analytics."""
