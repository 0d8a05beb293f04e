"""Spark-native analytics engine for knowledge-graph retrieval.

Operators take and return DataFrames.  Model calls (text generation,
embedding, reranking, tokenization) are injected functions; everything else is
declared with the DataFrame / SQL API so that Catalyst plans it.
"""

__version__ = "0.1.0"
