"""Text-corpus and network-operations analytics as Spark DataFrame operators."""
