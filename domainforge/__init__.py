"""PySpark-native analytics for interval-annotated sequences and their graphs."""
