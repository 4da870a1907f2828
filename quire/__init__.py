"""quire: a Spark-native engine for multilingual document collections."""
