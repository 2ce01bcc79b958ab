"""Private retrieval and token-level aggregation over text corpora, as Spark DataFrame plans."""
