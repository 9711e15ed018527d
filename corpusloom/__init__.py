"""A Spark-native engine for document corpora and assistant-interaction logs."""
