"""A Spark-native engine for keyed, ordered, frequently updated state."""
