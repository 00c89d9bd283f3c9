"""A Spark-native engine for evaluating recommender systems."""
