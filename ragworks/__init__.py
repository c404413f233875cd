"""Spark jobs that prepare document corpora for retrieval and measure retrieval."""
