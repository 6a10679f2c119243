"""A Spark-native engine for building and querying models over tables and events."""
