"""A PySpark-native engine for typed, test-first SQL pipelines and analytics."""
