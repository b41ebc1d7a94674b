"""Lodestone: a PySpark-native engine for knowledge corpora, hybrid retrieval and retrieval evaluation."""

__version__ = "0.1.0"
