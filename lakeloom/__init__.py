"""A Spark-native engine that turns loosely typed rows into typed, keyed, versioned tables."""
