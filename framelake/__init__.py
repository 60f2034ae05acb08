"""A Spark-native engine for reading text from screen images, for scoring such readings, and for preparing training data."""
