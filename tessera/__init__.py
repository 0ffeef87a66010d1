"""tessera: a Spark-native engine for preparing, packing, mining and evaluating retrieval data."""
