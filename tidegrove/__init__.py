"""A PySpark-native engine for learning and scoring on tables whose distribution changes over time."""
