"""A PySpark-native engine that trims, merges and tags sequencing reads."""
