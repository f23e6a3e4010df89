"""Structured Streaming forms of the series jobs: streaming DataFrame in, streaming DataFrame out."""
