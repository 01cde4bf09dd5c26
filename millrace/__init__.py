"""Spark-native web-content pipeline: crawl frontier, page processing, content store, search and metrics."""

__version__ = "0.1.0"
