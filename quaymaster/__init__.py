"""Quaymaster: a Spark-native engine for port-service billing data."""
