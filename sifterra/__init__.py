"""sifterra: Spark-first curation, deduplication, sampling and evaluation of text corpora."""

__version__ = "0.1.0"
