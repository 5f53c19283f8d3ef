"""Spark-native analytics for captured call-recording sessions."""
