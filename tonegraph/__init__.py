"""tonegraph: Spark-native similarity analytics over event-like note data."""
