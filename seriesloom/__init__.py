"""A Spark-native engine for labelled sensor series."""
