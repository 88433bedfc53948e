"""navspark: a PySpark-native engine for navigating, evaluating and preparing text corpora."""
