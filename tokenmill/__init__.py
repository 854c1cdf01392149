"""A PySpark-native engine for language-model corpora."""
