"""Evidence verification and training-data operators over document corpora, on Spark."""
