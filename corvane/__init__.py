"""corvane: a PySpark-native engine for preparing text corpora."""
