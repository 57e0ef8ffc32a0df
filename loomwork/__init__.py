"""Spark-first analytics over item catalogues, event sequences, vectors, text and membership graphs."""
