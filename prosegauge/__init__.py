"""Prose-quality measurement over tables and streams of documents, on Spark."""
