"""veldra: a PySpark-native engine for observation tables, similarity retrieval and decision logs."""
