"""Spark-native retrieval, ledger and governance analytics over text-memory corpora."""
