"""Spark-native analytics for data that is generated, judged and fed back into training."""
