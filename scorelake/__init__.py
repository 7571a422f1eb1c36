"""Spark-native scoring analytics: findings, confusion metrics, text similarity and resampling."""
