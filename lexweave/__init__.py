"""A Spark-native engine for document segmentation, hybrid retrieval and training-data preparation."""
