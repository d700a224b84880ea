"""Spark-native media moderation and compression analytics."""
