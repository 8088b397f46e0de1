"""numbra: a PySpark-native engine for arithmetic-heavy batch analytics over columnar files."""
